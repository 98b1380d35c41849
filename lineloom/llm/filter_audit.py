"""How filters act on each other: what every order of them removes, from one truth table a document.

1. *Facts*, one pass over the texts: which filters a document fails, as a bit mask.  Copies are told by a digest of the text; the
   smallest id of each text is found by an aggregate that combines before its shuffle, and joined back on digest *and*
   id, so that a text which a third of all documents hold is no hot key.
2. *Words*: bit ``S`` of a document's 32-bit word says that it survives the subset ``S`` of filters (it fails none of them).
3. *Counts*: every task adds the words of a part and label positionally by carry-save adders (three words of a weight give one of the
   same and one of the double weight), so a bit costs a few logical operations for many documents at once.  Tasks emit 32 sums for each
   part and label, which an ordinary aggregate adds up.
4. *Report*: what any order keeps, removes or loses is a difference of two subsets' survivors; no document is read again.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import string
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lineloom.workspace import Workspace

FILTERS = "ABCDE"
#: A filter that needs the whole table: the text of a smaller doc_id.
COPY = "E"
SUBSETS = 32
# Conditions of the text filters
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = "#$%&*|"
#: Keys that a task counts at once; beyond them it emits what it has and begins anew.
MOST_KEYS = 2_048

_CAPITALS = string.ascii_uppercase.encode()
_SYMBOLS = SYMBOLS.encode()


def text_failures(text: str | None) -> tuple[int, bytes]:
    """Bit mask of the text filters that ``text`` fails (A is bit 0), and a digest that equal texts share."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space: [\x20\x09-\x0D]
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITAL_PERCENT * len(text),
        len(raw.translate(None, _SYMBOLS)) < len(raw),
    )
    return sum(bit << i for i, bit in enumerate(fails)), hashlib.blake2b(raw, digest_size=16).digest()


def _judge_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        judged = [text_failures(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array([m for m, _ in judged], pa.int32()),
             pa.array([d for _, d in judged], pa.binary())],
            ["doc_id", "part", "fails", "digest"],
        )


def failures(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, part, fails`` for every row of ``docs``; ``fails`` has bit ``i`` set if the row fails filter ``i``.

    A null text counts as empty, a null source as the part ``''``.  Rows that repeat an id and its text are no copies of each other, and
    a row without an id neither is a copy nor has any.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    facts = workspace.table(rows.mapInArrow(_judge_texts, "doc_id bigint, part string, fails int, digest binary"), "facts")
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("is_first", F.lit(True))
    is_copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    with_copy = F.col("fails").bitwiseOR(F.lit(1 << FILTERS.index(COPY)))
    return facts.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(is_copy, with_copy).otherwise(F.col("fails")).alias("fails")
    )


def survival_word(fails: Column) -> Column:
    """Bit ``S`` of the word is set if a document with these failures survives every filter of the subset ``S``."""
    words = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
    return F.get(F.array(*[F.lit(w).cast("bigint") for w in words]), fails)


def with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``label``: 1 if a label row of the document says quality 1, plus 2 if one says toxic 1."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label")
    )
    return facts.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


# ---------------------------------------------------------------------------------------------------------------
# Positional counts by carry-save adders


class BitCounter:
    """Counts every bit position of a stream of 32-bit words; at most two words of each weight are held between calls."""

    def __init__(self):
        self.weights: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        level = 0
        while len(words):
            if level == len(self.weights):
                self.weights.append(np.empty(0, np.uint32))
            pool, carries = np.concatenate([self.weights[level], words]), []
            while len(pool) > 2:
                third = len(pool) // 3
                a, b, c = pool[:third], pool[third:2 * third], pool[2 * third:3 * third]
                either = a ^ b
                carries.append((a & b) | (either & c))
                pool = np.concatenate([either ^ c, pool[3 * third:]])
            self.weights[level] = pool
            words = np.concatenate(carries) if carries else np.empty(0, np.uint32)
            level += 1

    def counts(self) -> list[int]:
        return [
            sum(int(((words >> np.uint32(bit)) & np.uint32(1)).sum()) << level for level, words in enumerate(self.weights))
            for bit in range(SUBSETS)
        ]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters: dict[tuple[str, int], BitCounter] = {}

    def emit() -> pa.RecordBatch:
        keys = list(counters)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([counters[k].counts() for k in keys], pa.list_(pa.int64()))],
            ["part", "label", "survivors"],
        )

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        labels = batch.column("label").to_numpy()
        words = batch.column("word").to_numpy().astype(np.uint32)
        keys = parts.indices.to_numpy().astype(np.int64) * 4 + labels
        order = np.argsort(keys, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            if len(group):
                key = parts.dictionary[int(keys[group[0]]) // 4].as_py(), int(labels[group[0]])
                counters.setdefault(key, BitCounter()).add(words[group])
        if len(counters) > MOST_KEYS:
            yield emit()
            counters.clear()
    if counters:
        yield emit()


def subset_survivors(words: DataFrame) -> DataFrame:
    """From ``part, label, word``: a row for each part with arrays ``total``, ``good`` and ``toxic``, indexed by subset."""
    counted = words.select("part", F.col("label").cast("int").alias("label"), "word").mapInArrow(
        _count_words, "part string, label int, survivors array<bigint>"
    )

    def sums(held: Column) -> Column:
        return F.array(*[F.sum(F.when(held, F.get("survivors", F.lit(s))).otherwise(0)) for s in range(SUBSETS)])

    return counted.groupBy("part").agg(
        sums(F.lit(True)).alias("total"), sums(F.col("label").bitwiseAND(1) > 0).alias("good"),
        sums(F.col("label").bitwiseAND(2) > 0).alias("toxic"),
    )


# ---------------------------------------------------------------------------------------------------------------
# What every order does


def order_report(survivors: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: differences of the subsets' survivors."""
    every = (1 << len(filters)) - 1

    def mask(letters: Column) -> Column:
        held = [F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)]
        return sum(held[1:], held[0])

    def shapley(i: int) -> Column:
        terms = []
        for s in range(every + 1):
            if not s & 1 << i:
                size = s.bit_count()
                weight = math.factorial(size) * math.factorial(len(filters) - 1 - size)
                terms.append((F.get("total", F.lit(s)) - F.get("total", F.lit(s | 1 << i))) * F.lit(weight).cast("bigint"))
        return sum(terms[1:], terms[0])

    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    by_part = survivors.select("*", F.array(*[shapley(i) for i in range(len(filters))]).alias("by_filter"))
    rows = by_part.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    own = F.expr("substring(filter_order, step, 1)")
    rows = rows.withColumns({"before": mask(F.expr("left(filter_order, step - 1)")), "own": mask(own)})
    rows = rows.withColumn("after", F.col("before") + F.col("own"))

    def lost(counts: str) -> Column:
        return F.get(counts, F.col("before")) - F.get(counts, F.col("after"))

    return rows.select(
        "part", "filter_order", "step", F.get("total", F.col("after")).alias("kept"), lost("total").alias("removed"),
        (F.get("total", F.lit(0)) - F.get("total", F.col("own")) - lost("total")).alias("redundant"),
        (F.get("total", F.lit(every) - F.col("own")) - F.get("total", F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.expr(f"get(by_filter, instr('{''.join(filters)}', substring(filter_order, step, 1)) - 1)").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Every order of the five filters over ``docs``, for each part: see ``order_report`` for the columns.

    Rows without an id, repeated rows and empty texts count like any other row (``failures`` says how they are judged); a document without a
    label is neither good nor toxic, one with several label rows is what any of them says.  An empty table has no part and so no row.  Other
    columns of either table are not read.
    """
    facts = with_labels(failures(docs, workspace), labels)
    return order_report(subset_survivors(facts.select("part", "label", survival_word(F.col("fails")).alias("word"))))
