"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: ``[\x20\x09-\x0D]``
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Words of licence and benchmark texts: runs of digits, lower-case ASCII letters and anything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_A, _Z = ord("A"), ord("Z")
_LOWER = bytes(c + 32 if _A <= c <= _Z else c for c in range(256))
_PLAIN = bytes(
    c + 32 if _A <= c <= _Z else c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 32 for c in range(256)
)


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole input row as one struct ``row`` beside the columns an operator reads.

    Whatever the input's other columns are called, they cannot clash with a result.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells apart rows of one id with different texts; rows that agree in both are handled alike."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\x00")), F.col(doc_id))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.length(column) == F.octet_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, lower))


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().translate(_LOWER).split() if text else []


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


# ---------------------------------------------------------------------------------------------------------------
# Hashes of word windows, for whole batches at once

_U = np.uint64


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return stir(left * _U(0x9E3779B97F4A7C15) + right)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    if not tokens:
        return np.empty(0, _U)
    holder = np.empty(len(tokens), object)
    holder[:] = tokens
    return pd.util.hash_array(holder, categorize=False)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` neighbours, built from windows whose widths are powers of two."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, _U)
    done, reach, power, size = None, 0, hashes, 1
    while True:
        if width & size:
            part = power[reach:reach + count]
            done = part if done is None else pair_hash(done, part)
            reach += size
        if reach == width:
            return done
        power = pair_hash(power[:-size], power[size:])
        size *= 2


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """What ``np.unique`` returns, by a sort; on whole numbers that is many times faster than its hash table."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def text_chunks(texts: list[str | None], split, most_words: int = 400_000) -> Iterator[tuple[int, list, np.ndarray]]:
    """Neighbouring texts cut into words, ``most_words`` or one text at a time: first index, words, word counts."""
    first, held, counts = 0, [], []
    for i, text in enumerate(texts):
        tokens = split(text)
        if held and len(held) + len(tokens) > most_words:
            yield first, held, np.array(counts, np.int64)
            first, held, counts = i, [], []
        held.extend(tokens)
        counts.append(len(tokens))
    if counts:
        yield first, held, np.array(counts, np.int64)


def as_int64(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
