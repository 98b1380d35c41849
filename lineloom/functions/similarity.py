"""Similarity of token sequences (C1-C4).  The template (or leader) is always the first argument."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from lineloom.functions.masking import SEP, WILDCARD

METHODS = ("seqDist", "ngram", "jaccard", "combined")


def positional_matches(template: Column, message: Column) -> Column:
    same = F.zip_with(template, message, lambda t, m: (t == m) & (t != WILDCARD))
    return F.size(F.filter(same, lambda hit: hit))


def position_similarity(template: Column, message: Column) -> Column:
    """Share of positions with equal tokens; a wildcard of the template never counts.  NULL for no tokens."""
    return F.try_divide(positional_matches(template, message).cast("double"), F.size(template).cast("double"))


def wildcard_count(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: t == WILDCARD))


def jaccard_similarity(template: Column, message: Column) -> Column:
    """Over token sets; 0.0 when both are empty."""
    shared = F.size(F.array_intersect(template, message)).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(F.array_union(template, message)).cast("double")), F.lit(0.0))


def ngrams(tokens: Column, n: int) -> Column:
    """The token n-grams as strings, in order; empty for a sequence shorter than ``n``."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), SEP))
    return F.coalesce(grams, F.array().cast("array<string>"))


def ngram_hashes(tokens: Column, n: int) -> Column:
    """A number for each n-gram, in order: far cheaper to look up than its text.  Two that collide only raise ``ngram_bound``."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, n))), F.array().cast("array<bigint>"))


def ngram_bound(template_grams: Column, message_grams: Column) -> Column:
    """An upper bound of C2 from n-gram membership alone; cheap, and runs in the JVM.

    Pass columns that hold ``ngrams`` or ``ngram_hashes``, not the expressions: each is read once per n-gram of the other.
    """
    a, b = template_grams, message_grams
    # what one side lacks counts once however often the other has it: a set operation instead of a search for each n-gram
    common = F.least(F.size(a) - F.size(F.array_except(a, b)), F.size(b) - F.size(F.array_except(b, a)))
    return F.coalesce(
        F.try_divide(common.cast("double") * 2.0, (F.size(a) + F.size(b)).cast("double")), F.lit(0.0)
    )


def sequence_ratio(first: list, second: list, n: int) -> float:
    """Ratcliff-Obershelp ratio of two token lists over their n-grams."""
    if len(first) < n or len(second) < n:
        return 0.0
    grams = [[tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)] for seq in (first, second)]
    return SequenceMatcher(None, *grams).ratio()


#: Shapes whose ratio a task remembers, and the most tokens of such a pair.
SHAPES = 10_000
SHAPE_TOKENS = 256


def shaped_ratio(n: int) -> Callable[[Sequence, Sequence], float]:
    """``sequence_ratio`` that computes each *shape* of a pair once.

    The ratio depends on nothing but which tokens of the two lists are equal, and lines of one kind share that whatever their values are.
    """

    @lru_cache(SHAPES)
    def of_shape(size: int, shape: tuple) -> float:
        return sequence_ratio(shape[:size], shape[size:], n)

    def ratio(first: Sequence, second: Sequence) -> float:
        size = len(first)
        if size < n or len(second) < n:
            return 0.0
        if size + len(second) > SHAPE_TOKENS:
            return sequence_ratio(first, second, n)
        numbers: dict = {}
        number = numbers.setdefault
        return of_shape(size, tuple([number(token, len(numbers)) for token in chain(first, second)]))

    return ratio


def _numbered(*columns: pa.ListArray) -> list[list]:
    """The rows of each column as lists of numbers, equal for equal tokens anywhere; None for null."""
    values = pa.concat_arrays([column.values for column in columns])
    numbers = pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy().tolist()
    rows, start = [], 0
    for column in columns:
        ends = [start + end for end in column.offsets.to_numpy().tolist()]
        gone = column.is_null().to_numpy(zero_copy_only=False).tolist()
        rows.append([None if null else numbers[a:b] for a, b, null in zip(ends, ends[1:], gone)])
        start += len(column.values)
    return rows


def ngram_similarity(template: Column, message: Column, n: int = 3) -> Column:
    """C2.  The recursive longest-block rule has no expression form, so this is the one Arrow UDF here."""

    @F.arrow_udf("double")
    def ratios(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ratio = shaped_ratio(n)
        for t, m in batches:
            yield pa.array([None if a is None or b is None else ratio(a, b) for a, b in zip(*_numbered(t, m))], pa.float64())

    return ratios(template, message)


def native_similarity(method: str, template: Column, message: Column) -> Column:
    """The part of ``method`` that the JVM computes; 0.0 for ``ngram``."""
    if method == "seqDist":
        return F.coalesce(position_similarity(template, message), F.lit(0.0))
    if method == "jaccard":
        return jaccard_similarity(template, message)
    if method == "combined":
        return F.greatest(
            F.coalesce(position_similarity(template, message), F.lit(0.0)), jaccard_similarity(template, message)
        )
    if method == "ngram":
        return F.lit(0.0)
    raise ValueError(f"method must be one of {METHODS}, not {method!r}")


def needs_ngrams(method: str) -> bool:
    return method in ("ngram", "combined")


def combined_similarity(template: Column, message: Column, method: str = "combined", n: int = 3) -> Column:
    """C4: the method switch; ``combined`` is the largest of the three."""
    native = native_similarity(method, template, message)
    if not needs_ngrams(method):
        return native
    return F.greatest(native, ngram_similarity(template, message, n))


def pair_similarity(template: tuple, message: tuple, method: str, n: int) -> float:
    """The same measures for two token tuples inside a Python task."""
    best = 0.0
    if method in ("seqDist", "combined"):
        equal = sum(1 for t, m in zip(template, message) if t == m and t != WILDCARD)
        best = equal / len(template) if template else 0.0
    if method in ("jaccard", "combined"):
        a, b = set(template), set(message)
        best = max(best, len(a & b) / len(a | b) if a or b else 0.0)
    if needs_ngrams(method):
        best = max(best, sequence_ratio(list(template), list(message), n))
    return best
