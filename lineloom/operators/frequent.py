"""Which cells (a word at its position) of a set of messages are frequent, without moving the cells.

Messages come in chunks of about ``CHUNK`` cells.  A chunk asks once for each of its distinct cells, by a 63-bit number, in sorted blocks of that
number; a block sums up what all chunks ask and sends each the numbers that are frequent.  So a shuffle carries some six bytes for each distinct
cell of a chunk, every task holds a bounded part, and a very common word is one request of every chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.masking import SEP, WILDCARD

#: Cells of a chunk, and cells that a block of numbers stands for.
CHUNK = 1_000_000
# Cells that reach Python in one row: a batch has a fixed number of rows.
_PIECE = 1_000


def chunk_labels(sizes: Column) -> Column:
    """A label for each row, new where ``CHUNK`` cells are full; evaluate it in a table that is written."""

    @F.arrow_udf("bigint")
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first, before = uuid.uuid4().int >> 90 << 24, 0
        for sizes in batches:
            ends = before + np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
            before = int(ends[-1]) if len(ends) else before
            yield pa.array(first + ends // CHUNK, pa.int64())

    return labels(sizes)


def cell_numbers(signature: Column) -> Column:
    """A number for each word at its place; odd for a word that reads as a wildcard.  ``signature`` must not be empty."""
    return F.transform(
        F.split(signature, SEP),
        lambda word, i: F.shiftleft(F.xxhash64(i, word), 1).bitwiseOR((word == WILDCARD).cast("bigint")),
    )


def _planes(numbers: np.ndarray) -> bytes:
    """Byte by byte of all numbers: the upper bytes of sorted numbers, and those of small ones, shrink to nothing in a shuffle."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: pa.BinaryScalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, each with the sum of its counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _ask(blocks: int, enough: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def asked(chunk: int, held: list) -> pa.RecordBatch:
        keys, counts = _summed(np.concatenate([k for k, _ in held]).view(np.uint64), np.concatenate([n for _, n in held]))
        counts = np.minimum(counts, enough).astype(np.uint64)
        block = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
        parts = list(zip(cuts, cuts[1:] + [len(keys)]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block[cuts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()),
                pa.array([_planes(keys[a:b]) for a, b in parts], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in parts], pa.binary()),
            ],
            names=["Block", "Chunk", "Keys", "Counts"],
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk = [], 0, None
        for batch in batches:
            labels, lines = batch["Chunk"].to_numpy(), batch["n"].to_numpy()
            cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (labels[a] != chunk or size >= 2 * CHUNK):
                    yield asked(chunk, held)
                    held, size = [], 0
                numbers = batch["Numbers"].slice(a, b - a)
                held.append((numbers.flatten().to_numpy(), np.repeat(lines[a:b], pc.list_value_length(numbers).to_numpy())))
                chunk, size = int(labels[a]), size + len(held[-1][0])
        if held:
            yield asked(chunk, held)

    return ask


def _answer(support: int) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        asked = [_numbers(x) for x in table["Keys"]]
        keys, counts = _summed(np.concatenate(asked), np.concatenate([_numbers(x) for x in table["Counts"]]))
        known = keys[counts > support]
        found = [keys[_among(keys, known)] for keys in asked]
        return pa.table({"Chunk": table["Chunk"], "Keys": pa.array([_planes(x) for x in found], pa.binary())}).filter(
            pa.array([len(x) > 0 for x in found])
        )

    return answer


def frequent_numbers(sigs: DataFrame, support: int) -> DataFrame:
    """``Chunk, Keys``: the numbers of the cells of each chunk that more than ``support`` lines hold, packed, in one or more rows a chunk.

    ``sigs`` has ``Chunk, Signature, Size, n`` with ``n`` lines a row.
    """
    cells = sigs.agg(F.sum("Size")).first()[0] or 0
    pieces = F.transform(F.sequence(F.lit(1), F.size("Numbers"), F.lit(_PIECE)), lambda i: F.slice("Numbers", i, F.lit(_PIECE)))
    numbered = sigs.where(F.col("Size") > 0).select("Chunk", "n", cell_numbers(F.col("Signature")).alias("Numbers"))
    asked = numbered.select("Chunk", "n", F.explode(pieces).alias("Numbers")).mapInArrow(
        _ask(max(1, -(-cells // CHUNK)), support + 1), "Block bigint, Chunk bigint, Keys binary, Counts binary"
    )
    return asked.groupBy("Block").applyInArrow(_answer(support), "Chunk bigint, Keys binary")


def _describe(table: pa.Table, answers: pa.Table) -> pa.Table:
    numbers = table["Numbers"].combine_chunks()
    flat = numbers.flatten().to_numpy().view(np.uint64)
    known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_numbers(x) for x in answers["Keys"])]))
    keep = _among(flat, known)
    ends = np.cumsum(pc.list_value_length(numbers).to_numpy())
    starts = np.append(0, ends[:-1])
    held = np.add.reduceat(keep, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    # a frequent word that reads as a wildcard describes as little as one
    told = np.where(keep & (flat & np.uint64(1) == 0), flat, np.uint64(0))
    digests = [hashlib.blake2b(told[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]
    kept = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keep))
    out = table.select(["First", "Hash", "n", "Size"]).append_column("Digest", pa.array(digests, pa.binary())).append_column("Keep", kept)
    return out.filter(pa.array(held))


def describe(sigs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``First, Hash, n, Size, Digest, Keep`` of every row of ``sigs`` with a frequent cell: which of its words are, and a digest of those and their places."""
    tasks = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the numbers are made behind the shuffle
    rows = sigs.where(F.col("Size") > 0).repartition(tasks, "Chunk").withColumn("Numbers", cell_numbers(F.col("Signature"))).drop("Signature")
    schema = f"First {sigs.schema['First'].dataType.simpleString()}, Hash bigint, n bigint, Size int, Digest binary, Keep array<boolean>"
    return rows.groupBy("Chunk").cogroup(frequent.repartition(tasks, "Chunk").groupBy("Chunk")).applyInArrow(_describe, schema)
