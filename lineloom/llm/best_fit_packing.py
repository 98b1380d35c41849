"""Documents packed into few sequences of a fixed capacity: dominated alternatives are fixed first, the rest is best-fit.

Token counts are whole numbers up to the capacity, so the whole problem is one histogram of at most ``capacity`` counts, whatever the
number of documents.  Only that reaches the driver:

1. *Pieces*, one pass over the texts: token ids, cut where longer than a sequence; a piece also gets its place among the pieces of its length
   in its task.
2. *Reduction* (Martello and Toth) on the histogram: a set that dominates all others holding the longest piece is fixed for good, as many times as
   counts allow, and leaves a smaller instance with the same optimum.
3. *Best fit* on the remainder, longest first: equal pieces go together into equal gaps, so the steps follow the capacity and not the pieces.
4. *Places*: the plan is a list of patterns with multiplicities.  The n-th piece of a length is in a known run of equal slots, so
   sequence and offset are arithmetic on its number, which is its place plus those of the tasks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lineloom.workspace import Workspace

CAPACITY = 2_048
END_ID = 0


# ---------------------------------------------------------------------------------------------------------------
# Pieces


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str):
    """Encodes like ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, several times faster.

    The vocabulary and special strings are those of the file; ``tiktoken`` runs its merges, which are in the order of the ids.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t["content"]: t["id"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    byte = byte_level_bytes()
    ranks = {bytes(byte[c] for c in word): i for word, i in tokenizer.get_vocab(with_added_tokens=False).items() if word not in special}
    own = tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


#: The words of byte-level tokenizers (fixed: the pattern their pre-tokenizer is built on).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def cut(count: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; all but the first are full."""
    first = (count - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, count, capacity)]


def _cut_texts(path: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, encoder(path))
        part, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    out.append((piece, start, length, zlib.crc32(ids[start:start + length].tobytes()), part, used[length]))
                    used[length] += 1
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document; ``place`` numbers those of one length in one task (``part``) from 0."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
        "piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
    ).fields])
    return docs.select("doc_id", "text").mapInArrow(_cut_texts(tokenizer, capacity, end_id), schema)


# ---------------------------------------------------------------------------------------------------------------
# The plan, on counts by length


class Pattern(NamedTuple):
    """``count`` sequences that hold the same lengths: ``runs`` of ``(length, how often)``."""

    runs: tuple[tuple[int, int], ...]
    count: int


def _largest_pair(sizes: np.ndarray, counts: np.ndarray, room: int, least: int = 0) -> int:
    """Largest sum within ``room`` of two pieces longer than ``least``; 0 if none fit together."""
    sizes = sizes[sizes > least]
    if not len(sizes):
        return 0
    at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), side="right") - 1
    twin = (at >= 0) & (sizes[at] == sizes) & (counts[sizes] < 2)
    at = np.where(twin, at - 1, at)
    fits = at >= 0
    return int((sizes[fits] + sizes[at[fits]]).max(initial=0))


def dominating(size: int, counts: np.ndarray) -> tuple[int, ...] | None:
    """Partners of a piece in a set that dominates every other set holding it, or None if that can't be told.

    A set dominates another if the other's pieces can be dealt to places of pieces no shorter than their sums.  One piece that fills the room
    dominates all; the longest that fits does if two more never fit, or not with a larger sum; a pair does if every other pair has its shorter piece
    within the pair's shorter one, or its sum within the longer one, and three more never fit.
    """
    room = len(counts) - 1 - size
    counts = counts.copy()
    counts[size] -= 1
    sizes = np.flatnonzero(counts)
    fitting = sizes[sizes <= room]
    if not len(fitting):
        return ()
    longest = int(fitting[-1])
    if longest == room:
        return (longest,)
    shortest = np.repeat(fitting[:3], np.minimum(counts[fitting[:3]], 3))[:3]
    if len(shortest) < 2 or shortest[:2].sum() > room:
        return (longest,)
    if len(shortest) == 3 and shortest.sum() <= room:
        return None
    if _largest_pair(fitting, counts, room) <= longest:
        return (longest,)
    counts[longest] -= 1
    second = fitting[(fitting <= room - longest) & (counts[fitting] > 0)]
    counts[longest] += 1
    if len(second) and _largest_pair(fitting, counts, room, int(second[-1])) <= longest:
        return longest, int(second[-1])
    return None


def _runs(sizes: Iterable[int]) -> tuple[tuple[int, int], ...]:
    found: dict[int, int] = {}
    for size in sizes:
        found[size] = found.get(size, 0) + 1
    return tuple(found.items())


def reduce_instance(counts: np.ndarray) -> tuple[list[Pattern], np.ndarray]:
    """Sets fixed for good, and the counts that remain; both together need as few sequences as the whole.

    A dominating set is fixed as often as its pieces last: what is taken out only leaves fewer alternatives.
    """
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for size in range(len(counts) - 1, 0, -1):
            while counts[size]:
                partners = dominating(size, counts)
                if partners is None:
                    break
                runs = _runs((size, *partners))
                times = min(int(counts[s]) // often for s, often in runs)
                for s, often in runs:
                    counts[s] -= times * often
                fixed.append(Pattern(runs, times))
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit, longest first: each piece goes where it leaves least room; equal pieces and equal gaps are taken together."""
    capacity = len(counts) - 1
    open_: dict[int, list[Pattern]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in sorted(r for r in open_ if r >= size):
            each, groups = room // size, open_.pop(room)
            while groups:
                runs, count = groups.pop()
                full = min(count, left // each)
                rest = left - full * each if full < count else 0
                left -= full * each + rest
                for often, many in ((each, full), (rest, 1 if rest else 0), (0, count - full - (rest > 0))):
                    if many:
                        more = ((size, often),) if often else ()
                        open_.setdefault(room - often * size, []).append(Pattern(runs + more, many))
                if not left:
                    break
            if groups:
                open_.setdefault(room, []).extend(groups)
            if not left:
                break
        each = capacity // size
        for often, many in ((each, left // each), (left % each, 1 if left % each else 0)):
            if many:
                open_.setdefault(capacity - often * size, []).append(Pattern(((size, often),), many))
    return [pattern for patterns in open_.values() for pattern in patterns]


def packing_plan(counts: np.ndarray) -> list[Pattern]:
    """Patterns for ``counts[length]`` pieces of each length up to the capacity."""
    fixed, rest = reduce_instance(counts)
    return fixed + best_fit(rest)


# ---------------------------------------------------------------------------------------------------------------
# Places


def _slots(plan: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first number, first sequence, pieces in each sequence, first offset of its runs of slots."""
    rows: dict[int, list] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for runs, count in plan:
        offset = 0
        for size, often in runs:
            rows.setdefault(size, []).append((filled.get(size, 0), sequence, often, offset))
            filled[size] = filled.get(size, 0) + often * count
            offset += size * often
        sequence += count
    return {size: tuple(np.array(c, np.int64) for c in zip(*found)) for size, found in rows.items()}


def _place(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for size in np.unique(lengths):
                own = lengths == size
                first, base, often, begin = slots[int(size)]
                run_ = np.searchsorted(first, numbers[own], side="right") - 1
                within = numbers[own] - first[run_]
                sequence[own] = base[run_] + within // often[run_]
                offset[own] = begin[run_] + within % often[run_] * size
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    A null text is empty and is one piece, the end id; rows that repeat an id are documents of their own, as are rows without one.  An empty table gives no
    piece.  Other columns are not read.  The driver sees one count for each length.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    found = workspace.table(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = workspace.table(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # capacity rows at most
        counts[length] = n
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = found.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("number")
    )
    schema = T.StructType(numbered.schema.fields[:5] + T.StructType.fromDDL("sequence_id bigint, offset bigint").fields)
    return numbered.mapInArrow(_place(_slots(packing_plan(counts))), schema)
