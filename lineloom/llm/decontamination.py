"""Benchmark passages in documents, found by a Wu-Manber search over words.

Patterns are all windows of ``window`` consecutive words of the benchmark items; an item with fewer words is one
pattern.  Patterns of one length form one search table.  The last two words of the inspected position are looked up in
the *shift table*: a pair that stands in no pattern lets the search skip almost a whole pattern length, a pair that stands
earlier in some pattern skips up to that place.  Only where the pair ends a pattern, its bucket of patterns (keyed by
that suffix) is consulted and the words themselves are compared.

The documents are read once for each block of benchmark items and never shuffled; a block holds about ``block_words``
words, so the table that travels to the tasks has a fixed size however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lineloom.llm.rows import PLAIN_WORD, ascii_lower, carried, plain_words

WINDOW = 10
BLOCK_WORDS = 200_000


class PatternTable:
    """The shift table and the suffix buckets of all patterns that have one length."""

    def __init__(self, length: int):
        self.length = length
        self.span = min(2, length)  # words in a block
        self.skip = length - self.span + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, pattern: tuple, item: str) -> None:
        for end in range(self.span, self.length + 1):
            block = pattern[end - self.span:end]
            self.shift[block] = min(self.shift.get(block, self.skip), self.length - end)
        self.buckets.setdefault(pattern[-self.span:], {}).setdefault(pattern, set()).add(item)

    def search(self, tokens: list) -> Iterator[tuple[int, set]]:
        """Start of each occurrence, and the items that hold the words found there."""
        length, span, skip, shift = self.length, self.span, self.skip, self.shift
        end, stop = length, len(tokens)
        while end <= stop:
            block = tuple(tokens[end - span:end])
            step = shift.get(block, skip)
            if step:
                end += step
                continue
            found = self.buckets[block].get(tuple(tokens[end - length:end]))
            if found:
                yield end - length, found
            end += 1


def pattern_tables(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> tuple[dict, list[PatternTable]]:
    """Numbers of the pattern words, and a table for each pattern length."""
    numbers: dict[bytes, int] = {}
    tables: dict[int, PatternTable] = {}
    for item, text in items:
        tokens = [numbers.setdefault(w, len(numbers) + 1) for w in plain_words(text)]
        length = min(window, len(tokens))
        for start in range(len(tokens) - length + 1 if length else 0):
            tables.setdefault(length, PatternTable(length)).add(tuple(tokens[start:start + length]), item)
    return numbers, list(tables.values())


def merge_spans(spans: list) -> list:
    """Sorted, joined where they touch."""
    merged: list = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _scan(numbers: dict, tables: list[PatternTable]):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = [number(w, 0) for w in plain_words(text)]
                spans, names = [], set()
                for table in tables:
                    for start, found in table.search(tokens):
                        spans.append((start, start + table.length))
                        names |= found
                if spans:
                    spans += [(x["start"], x["end"]) for x in hits[i]]
                    hits[i] = [{"start": a, "end": b} for a, b in merge_spans(spans)]
                    items[i] = sorted(names.union(items[i]))
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns |= {"hits": pa.array(hits, spans_type), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Columns ``row`` (the input row), ``n_words``, ``hits`` (word ranges, end exclusive), ``items`` (sorted ids).

    A null or empty text has no words and is never hit; an item without words is in no document.  Rows that share an
    ``item_id`` count as one item, a null id as the empty string.  Repeated documents are judged one by one.
    """
    patterns = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("passage")
    )
    total = patterns.agg(F.sum(F.regexp_count(ascii_lower(F.col("passage")), F.lit(PLAIN_WORD)))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item", "passage"), F.lit(blocks))
    found = carried(docs, "text").select(
        "row", "text",
        F.regexp_count(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(PLAIN_WORD)).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in found.schema])
    for number in range(blocks):
        held = patterns.where(block == number).collect()  # a block's words, whatever the benchmark's size
        found = found.mapInArrow(_scan(*pattern_tables(held, window)), schema)
    return found.select("row", "n_words", "hits", "items")


def contamination_report(found: DataFrame) -> DataFrame:
    """One digest row for each document."""
    covered = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns as they are, in which no window of the benchmark occurs."""
    return find_contamination(docs, benchmark, window).where(F.size("hits") == 0).select("row.*")
