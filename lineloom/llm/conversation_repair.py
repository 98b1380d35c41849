"""The cheapest repair of conversations whose turns do not alternate, or are blank, repeated or cut off.

Rows are dealt by conversation and sorted by turn, so a conversation streams through one task, batch after batch, however long it is:

1. *Faults*: whether role and text were seen earlier is found by an aggregate over digests (combined before its shuffle); only
   the rows that repeat become markers in the stream, so no task holds a conversation's texts.
2. *Plan*: a dynamic program over the four states of the role pattern runs along the stream.  Costs relative to the cheapest state and the order
   of the states' edit strings are all it has to know; there are few such combinations, so a row is one look-up, and its backpointers are the
   number of that transition.  Blocks of these numbers are compressed as soon as they are full; at the conversation's end the edits are
   read back from them.
3. *Repair*: rows stream once more, the plan ahead of them, and come out as repaired turns in order.

A task never holds more than one batch, the packed backpointers and one edit string.  ``mapInArrow`` is used, not its pandas form, because
turns and ids may be null and must stay whole numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lineloom.llm.rows import BLANKS
from lineloom.workspace import Workspace

# Costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Role patterns are ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
_NEXT = {
    (EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: More neighbouring insertions than these go round the pattern at a cost and change nothing.
_MOST_INSERTED = 2
BLOCK = 65_536


def _wanted(state: int) -> str:
    """The one role that an inserted or renamed turn can have after ``state``."""
    return "a" if state == USER else "u"


def _after_insertions(state: int) -> Iterator[tuple[int, int, str]]:
    for count in range(_MOST_INSERTED + 1):
        yield state, INSERT * count, "I" * count
        state = _NEXT[state, _wanted(state)]


def _edits(state: int, initial: str, delete: bool, truncated: bool) -> Iterator[tuple[int, int, str]]:
    """Ways to get a row into the repaired conversation, or out of it: next state, cost, letters."""
    for between, cost, letters in _after_insertions(state):
        yield between, cost + DELETE, letters + "D"
        if not delete:
            if (between, initial) in _NEXT:
                yield _NEXT[between, initial], cost + TRUNCATED * truncated, letters + "K"
            yield _NEXT[between, _wanted(between)], cost + REROLE + TRUNCATED * truncated, letters + "R"


class Planner:
    """The program's table: combinations of relative costs and ranks, and their transitions, numbered as they are met.

    After a row no edit string is the beginning of another state's, because all end in that row's letter; so the order of two strings never changes
    by what follows, and a rank for each state is enough to settle ties.
    """

    def __init__(self):
        self.start = ((0, 0), None, None, None)
        self.known: dict[tuple, tuple] = {}
        self.back: list[tuple] = []

    def step(self, combination: tuple, row: tuple[str, bool, bool]) -> tuple[tuple, int, int]:
        """Next combination, rise of the least cost, number of the transition."""
        key = combination, row
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._transition(combination, row)
        return found

    def _transition(self, combination, row):
        best: list[tuple | None] = [None] * 4
        for state, at in enumerate(combination):
            if at is not None:
                for to, cost, letters in _edits(state, *row):
                    way = at[0] + cost, at[1], letters, state
                    if best[to] is None or way < best[to]:
                        best[to] = way
        ranked = sorted((to for to in range(4) if best[to]), key=lambda to: best[to][1:3])
        least = min(way[0] for way in best if way)
        after = tuple((best[to][0] - least, ranked.index(to)) if best[to] else None for to in range(4))
        self.back.append(tuple((way[3], way[2]) if way else None for way in best))
        return after, least, len(self.back) - 1

    def finish(self, combination: tuple) -> tuple[int, int, str]:
        """Cost above the least one, state before the last insertions, and these."""
        ways = []
        for state, at in enumerate(combination):
            if at is not None:
                for end, cost, letters in _after_insertions(state):
                    if end in (EMPTY, ASSISTANT):
                        ways.append((at[0] + cost, at[1], letters, state))
        cost, _, letters, state = min(ways)
        return cost, state, letters


class Trail:
    """Numbers of transitions, packed block by block and read from the end."""

    def __init__(self):
        self.packed: list[bytes] = []
        self.open = array("I")

    def append(self, number: int) -> None:
        self.open.append(number)
        if len(self.open) == BLOCK:
            self.packed.append(zlib.compress(self.open.tobytes(), 1))
            self.open = array("I")

    def backwards(self) -> Iterator[array]:
        yield self.open
        for block in reversed(self.packed):
            yield array("I", zlib.decompress(block))

    def letters(self, back: list[tuple], state: int, last: str) -> str:
        parts = [last]
        for block in self.backwards():
            found = []
            for number in reversed(block):
                state, letters = back[number][state]
                found.append(letters)
            parts.append("".join(reversed(found)))
        return "".join(reversed(parts))


class _Conversation:
    def __init__(self, planner: Planner):
        self.planner, self.trail = planner, Trail()
        self.combination, self.cost = planner.start, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.turn = None
        self.turns = 0
        self.initial: str | None = None
        self.marked = self.before = None

    def mark(self, place: tuple) -> None:
        self.marked = place

    def take(self, turn, place: tuple, initial: str, blank: bool, cut: bool) -> None:
        if turn is not None and (not self.turns or turn != self.high):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None and (self.initial, initial) not in _LEGAL:
            self.illegal += 1
        duplicate = not blank and place in (self.marked, self.before)
        cut = cut and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        self.initial, self.before = initial, place
        self.combination, rise, number = self.planner.step(self.combination, (initial, blank or duplicate, cut))
        self.cost += rise
        self.trail.append(number)

    def report(self) -> tuple:
        rest, state, last = self.planner.finish(self.combination)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit = self.trail.letters(self.planner.back, state, last)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + rest, audit


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _plan(id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planner = Planner()
        current, held, done = None, None, []

        def emit() -> pa.RecordBatch:
            ids = pa.array([d[0] for d in done], id_type)
            counts = [pa.array([d[1][i] for d in done], pa.int64()) for i in range(6)]
            out = pa.RecordBatch.from_arrays([ids, *counts, pa.array([d[1][6] for d in done], pa.string())], ["conv_id", *_REPORT])
            done.clear()
            return out

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "digest", "copy", "initial", "blank", "cut"))
            for conv, kind, turn, digest, copy, initial, blank, cut in zip(*columns):
                if held is None or conv != current:
                    if held is not None:
                        done.append((current, held.report()))
                    current, held = conv, _Conversation(planner)
                if kind == _MARKER:
                    held.mark((turn, digest, copy))
                elif kind == _ROW:
                    held.take(turn, (turn, digest, copy), initial, blank, cut)
            if done:
                yield emit()
        if held is not None:
            done.append((current, held.report()))
            yield emit()

    return run


# What a row of the stream is; the order is that within a place
_PRESENT, _MARKER, _ROW = 0, 1, 2


def _streamed(rows: DataFrame) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), F.col("digest").asc_nulls_first(), "copy", "kind"
    )


def _with_facts(turns: DataFrame) -> DataFrame:
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), copy.cast("int").alias("copy"), dropped.alias("dropped"),
    )
    kept = F.rtrim("text", F.lit(BLANKS))
    return rows.select(
        "*", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        F.substring("role", 1, 1).alias("initial"), (F.length(kept) == 0).alias("blank"),
        (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def plan_repairs(turns: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``conv_id`` with its faults, the cost of the cheapest repair and ``audit``, its edits in order (K, R, D, I).

    ``turns`` has ``conv_id, turn, role, text``; a column ``copy`` orders rows that are otherwise alike, and rows with a true ``dropped`` only say that
    there is such a conversation.  Rows of one turn are taken in the order of a digest of role and text.  A null role or text is one space, null turns
    come first, rows without a ``conv_id`` are one conversation, an empty role fits nowhere.  Repeated rows are duplicates.  Other columns are not read.
    """
    workspace = workspace or Workspace(turns.sparkSession)
    facts = _with_facts(turns)
    there = facts.where(~F.col("dropped"))
    place = F.struct("turn", "copy")
    seen = there.where(~F.col("blank")).select("conv_id", "digest", place.alias("place"))
    repeated = seen.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = workspace.table(repeated.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"), "repeated")
    later = seen.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(
        ~F.col("place").eqNullSafe(F.col("first"))
    )
    markers = later.select("conv_id", F.lit(_MARKER).alias("kind"), "place.turn", "digest", "place.copy").distinct()
    present = facts.where("dropped").select("conv_id", F.lit(_PRESENT).alias("kind"), F.lit(0).alias("copy")).distinct()
    rows = there.select("conv_id", F.lit(_ROW).alias("kind"), "turn", "digest", "copy", "initial", "blank", "cut")
    stream = _streamed(rows.unionByName(markers, allowMissingColumns=True).unionByName(present, allowMissingColumns=True))
    schema = T.StructType([turns.schema["conv_id"]] + [
        T.StructField(c, T.StringType() if c == "audit" else T.LongType()) for c in _REPORT
    ])
    return stream.mapInArrow(_plan(_arrow_type(turns)), schema)


def _arrow_type(turns: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(turns.schema["conv_id"].dataType)


# ---------------------------------------------------------------------------------------------------------------
# Repaired turns

_ROLES = {"u": "user", "a": "assistant"}


def _repair(id_type: pa.DataType):
    names = ["conv_id", "place", "edit", "role", "text"]
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, EMPTY, 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", _ROLES[_wanted(state)], ""))
                state, at, place = _NEXT[state, _wanted(state)], at + 1, place + 1

        def emit() -> pa.RecordBatch:
            arrays = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for own, kind, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit"))):
                if kind == _PRESENT:
                    insert()
                    conv, audit, at, state, place = own, edits, 0, EMPTY, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit != "D":
                    initial = _wanted(state) if edit == "R" else role[:1]
                    out.append((conv, place, edit, _ROLES[initial] if edit == "R" else role, text))
                    state, place = _NEXT[state, initial], place + 1
            if out:
                yield emit()
        insert()
        if out:
            yield emit()

    return run


def apply_repairs(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired conversations, in order within each partition."""
    rows = _with_facts(turns).where(~F.col("dropped")).select(
        "conv_id", F.lit(_ROW).alias("kind"), "turn", "digest", "copy", "role", "text"
    )
    ahead = plans.select("conv_id", F.lit(_PRESENT).alias("kind"), F.lit(-1).alias("copy"), "audit")
    stream = _streamed(rows.unionByName(ahead, allowMissingColumns=True))
    schema = T.StructType([
        turns.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])
    return stream.mapInArrow(_repair(_arrow_type(turns)), schema)


def _digests(id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, done = None, None, []

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done], pa.string())], ["c", "sha"]
            )
            done.clear()
            return out

        for batch in batches:
            for own, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = own, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield emit()
        if running is not None:
            done.append((conv, running.hexdigest()))
            yield emit()

    return run


def repair_report(turns: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """The plans with ``repaired_sha256``, taken over the repaired turns as they stream out of ``apply_repairs``."""
    workspace = workspace or Workspace(turns.sparkSession)
    plans = workspace.table(plan_repairs(turns, workspace), "plans")
    schema = T.StructType([T.StructField("c", turns.schema["conv_id"].dataType), T.StructField("sha", T.StringType())])
    digests = apply_repairs(turns, plans).mapInArrow(_digests(_arrow_type(turns)), schema)
    nothing = hashlib.sha256(b"").hexdigest()
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *_REPORT, F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256")
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Known faults for a test of the repair: about one row in 20 of each kind, chosen by the checksum of ``conv_id:turn``.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role ``user``.
    """
    def said(column: str) -> F.Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("kind") == 0).alias("dropped"),
    )
