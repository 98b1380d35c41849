"""Secrets in text: known forms by pattern, unknown ones by the entropy of their characters.

Built-in functions only, one pass, no shuffle.  Patterns give positions without a matcher of their own: the text is split at the matches,
and the lengths of pieces and matches add up to the places.

Base spans and allow-list matches are blanked out, place by place, and what is left of a run of key characters is judged by
itself, so a random part keeps its span beside a path, a known key or a row of equal letters.  Candidates are the runs of 20 and more
that hold a digit and are no name made of words.  A window slides over each; characters are counted as they enter and leave, so
``sum(c * log2(c))`` is kept by increments and the Shannon entropy of every window is ``log2(w) - sum / w``.  A candidate whose best window
reaches the threshold of its character class is a span.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed forms
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of these is maximal, so asking for the least length in the pattern finds the same places as dropping short ones
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


@dataclass(frozen=True)
class CharacterClass:
    pattern: str
    window: int
    threshold: float


#: The first class that fits a candidate counts
CLASSES = (
    CharacterClass(r"^[0-9]+$", 20, 3.2),
    CharacterClass(r"^[0-9A-Fa-f]+$", 20, 2.9),
    CharacterClass(r"^[A-Za-z0-9+/_=-]+$", 20, 3.6),
)
#: Placeholders: what matches is no part of a secret.  A word takes the letters and digits around it along, up to the next separator; it is
#: looked for from the start of these only, so a long run costs one pass.
ALLOWED = (r"(?i)(?<![a-z0-9])[a-z0-9]*?(?:example|placeholder|changeme|dummy|sample)[a-z0-9]*", r"(.)\1{5,}")
#: Runs that are names made of words
NAMES = r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}$"

_SPAN = "array<struct<start:int,rank:int,stop:int,found:string>>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All matches: ``start``, ``rank``, ``stop`` and the text of ``group``.

    Pieces and matches are added up in blocks of the square root of their number, then the blocks: a list that grows by one copy a match would
    make the work quadratic.
    """
    lengths = lambda parts: F.transform(parts, F.length)
    pieces = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("width"),
        F.regexp_extract_all(text, F.lit(pattern), group).alias("found"),
    )
    none = F.array().cast(_SPAN)

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + x["gap"]
        end = begin + F.coalesce(x["width"], F.lit(0))
        one = F.array(F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), x["found"].alias("found")
        )).cast(_SPAN)
        last = x["width"].isNull()  # what follows the last match
        return F.struct(end.alias("at"), F.when(last, done["spans"]).otherwise(F.concat(done["spans"], one)).alias("spans"))

    def blocks(all_pieces: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(all_pieces))).cast("int")
        count = F.ceil(F.size(all_pieces) / block).cast("int")
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.aggregate(F.slice(all_pieces, k * block + 1, block), start, step),
        )

    def placed(done: Column) -> Column:
        ends = F.aggregate(done, F.array(F.lit(0)), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + x["at"])))
        moved = F.zip_with(done, F.slice(ends, F.lit(1), F.size(done)), lambda x, at: F.transform(x["spans"], lambda s: F.struct(
            (s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["stop"] + at).alias("stop"), s["found"].alias("found")
        )))
        return F.flatten(moved).cast(_SPAN)

    spans = _bound(_bound(pieces, blocks), placed)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _blanked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``text`` with blanks in place of all matches whose ``group`` has ``least`` characters: every place stays where it is."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), group).alias("value"),
    )
    blank = lambda x: F.when(F.length(x["value"]) >= least, F.repeat(F.lit(" "), F.length(x["found"]))).otherwise(x["found"])
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(blank(x), F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def window_entropy(value: Column, window: int) -> Column:
    """The largest entropy of ``window`` neighbouring characters, -1 for a shorter string."""
    place = lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))) - 1
    length = F.length(value)

    def events(i: Column) -> Column:
        """A character enters; the one that is a window behind leaves; then the window may be complete."""
        enter = F.struct(place(i).alias("at"), F.lit(1).alias("step"), (i == window).alias("full"))
        leave = F.struct(
            F.when(i > window, place(i - window)).otherwise(F.lit(0)).alias("at"),
            F.when(i > window, F.lit(-1)).otherwise(F.lit(0)).alias("step"), (i >= window).alias("full"),
        )
        return F.array(enter, leave)

    def weight(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))

    def step(done: Column, e: Column) -> Column:
        count = F.get(done["counts"], e["at"])
        total = done["total"] + weight(count + e["step"]) - weight(count)
        entropy = F.lit(math.log2(window)) - total / F.lit(float(window))
        return F.struct(
            F.transform(done["counts"], lambda c, i: F.when(i == e["at"], c + e["step"]).otherwise(c)).alias("counts"),
            total.alias("total"),
            F.when(e["full"], F.greatest(done["best"], entropy)).otherwise(done["best"]).alias("best"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best")
    )
    steps = F.flatten(F.transform(F.sequence(F.lit(1), length), events))
    return F.when(length >= window, F.aggregate(steps, start, step, lambda done: done["best"])).otherwise(F.lit(-1.0))


def _is_random(value: Column, classes: Sequence[CharacterClass]) -> Column:
    test = None
    for kind in classes:
        high = window_entropy(value, kind.window) >= kind.threshold
        test = F.when(value.rlike(kind.pattern), high) if test is None else test.when(value.rlike(kind.pattern), high)
    return test.otherwise(F.lit(False))


def find_secrets(
    docs: DataFrame, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED, names: str = NAMES
) -> DataFrame:
    """``doc_id, base, extra`` for every row: sorted spans (code points, end exclusive) of the base kinds and of the method.

    Parts of a run that match ``allowed`` and runs that match ``names`` are no secrets.  A null or empty text has none.  Rows are read
    one by one, so repeated rows agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["found"]) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    found = docs.select("doc_id", base.alias("base"), _blanked(text, ASSIGN, 2, ASSIGN_LEAST).alias("rest"))
    # a step of its own for each pattern: the text before it is read several times
    for pattern in (ACCESS, HEX, *allowed):
        found = found.select("doc_id", "base", _blanked(F.col("rest"), pattern).alias("rest"))

    def wanted(s: Column) -> Column:
        return F.when(s["found"].rlike("[0-9]") & ~s["found"].rlike(names), _is_random(s["found"], classes)).otherwise(F.lit(False))

    return found.select("doc_id", "base", F.filter(_spans(F.col("rest"), CANDIDATE, 3), wanted).alias("extra"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def secret_report(found: DataFrame) -> DataFrame:
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
