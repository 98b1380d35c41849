"""Long passages that occur more than once, word for word: De Bruijn compaction over word k-mers.

The edges of the graph are the windows of ``window`` words.  Writing and shuffling every edge would multiply the text, so
edges travel in bundles: each window has a *minimizer*, the ``SEED_WORDS``-word piece in it with the smallest hash, and
neighbouring windows with the same minimizer form one *stretch*, identified by the minimizer and a digest of the very
words at its source coordinates.

1. One pass gives every stretch its coordinates.  Stretches whose minimizer occurs once hold no repeated edge and go.
2. Equal stretches are one class.  One place of each class is read again from its source coordinates and becomes segments of the
   graph: where no other class has the minimizer, the whole class is one segment; where classes share it, every window is a
   segment of its own.  Segments with several places stay.
3. A whole class is cut at an inner node where a segment of another minimizer ends or starts.  Such a node has the minimizer of
   the class it lies in, so a join by minimizer finds it; from then on every branch is the end of a segment.
4. A node (``window - 1`` words) that exactly one segment enters and exactly one leaves does not branch.  Joins on these nodes compact
   the segments to paths: tasks contract the links of the documents they hold, star rounds join what is left.
5. Paths go back to the places of their classes; neighbouring pieces of one path become one span of the document, and spans are
   removed from the texts.

A repeated edge has the same minimizer everywhere, so none is missed.  Classes are counted before they are shuffled, and
only joins see a minimizer or stretch that very many documents hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lineloom.llm.components import connected_components, contracted_by
from lineloom.llm.rows import as_int64, row_key, text_chunks, window_hashes, word_hashes, words
from lineloom.workspace import Workspace

WINDOW = 35
SEED_WORDS = 8


def _minimizer_places(pieces: np.ndarray, per_window: int) -> np.ndarray:
    """Place of the smallest hash, the first one of equals, in every run of ``per_window`` pieces."""
    best = np.arange(len(pieces) - per_window + 1)
    value = pieces[:len(best)].copy()
    for step in range(1, per_window):
        other = pieces[step:step + len(best)]
        less = other < value
        value[less] = other[less]
        best[less] = (np.flatnonzero(less) + step)
    return best


def _stretches(window: int, seed_words: int):
    seed_words = min(seed_words, window)
    per_window = window - seed_words + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for first, tokens, counts in text_chunks(batch.column("text").to_pylist(), words):
                ends = np.cumsum(counts)
                if len(tokens) < window:
                    continue
                pieces = window_hashes(word_hashes(tokens), seed_words)
                best = _minimizer_places(pieces, per_window)
                owner = np.repeat(np.arange(len(counts)), counts)
                inside = owner[:len(best)] == owner[window - 1:window - 1 + len(best)]
                starts = np.flatnonzero(inside)
                if not len(starts):
                    continue
                at = best[starts]
                new = np.r_[True, (np.diff(at) != 0) | (np.diff(starts) != 1)]
                from_ = starts[new]
                to = np.r_[starts[np.flatnonzero(new)[1:] - 1], starts[-1]]
                minimizers = pieces[at[new]]
                digests = np.fromiter(
                    (int.from_bytes(hashlib.blake2b(b" ".join(tokens[a:b + window]), digest_size=8).digest(), "little")
                     for a, b in zip(from_, to)), np.uint64, len(from_),
                )
                docs = owner[from_]
                base = (ends - counts)[docs]
                which = pa.array(docs + first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(which), keys.take(which), pa.array((from_ - base).astype(np.int32)),
                     pa.array((to - base).astype(np.int32)), pa.array(as_int64(minimizers)), pa.array(as_int64(digests))],
                    ["doc_id", "row_key", "first", "last", "minimizer", "digest"],
                )

    return run


def stretches(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """``doc_id, row_key, first, last, minimizer, digest``: windows ``first`` to ``last`` of a document."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_key", T.LongType()),
        T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
        T.StructField("minimizer", T.LongType()), T.StructField("digest", T.LongType()),
    ])
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    return rows.mapInArrow(_stretches(window, seed_words), schema)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, packed: a third of the bytes travel."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress(b" ".join(words(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(packed, pa.binary())],
            ["doc_id", "row_key", "packed"],
        )


def _packed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_key", T.LongType()),
        T.StructField("packed", T.BinaryType()),
    ])
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(_pack, schema)


def _unpack(packed: bytes) -> list[bytes]:
    text = zstandard.decompress(packed)
    return text.split(b" ") if text else []


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i]`` and the numbers after it, ``count[i]`` of them, for every i."""
    ends = np.cumsum(count)
    return np.arange(int(count.sum())) + np.repeat(first - (ends - count), count)


def _cut(window: int, seed_words: int):
    """Segments of the classes of a document: heads, tails and inner nodes by the words at the source coordinates."""
    seed_words = min(seed_words, window)
    per_node = window - seed_words  # pieces of a node

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("packed").to_pylist()):
                hashes = word_hashes(_unpack(packed))
                edges, nodes = as_int64(window_hashes(hashes, window)), as_int64(window_hashes(hashes, window - 1))
                if per_node:
                    pieces = window_hashes(hashes, seed_words)
                    least = as_int64(pieces[_minimizer_places(pieces, per_node)])
                else:
                    least = np.zeros(len(nodes), np.int64)
                parts = batch.column("parts")[i].values
                first, last, minimizer, digest, places, whole = (
                    parts.field(k).to_numpy(zero_copy_only=False)
                    for k in ("first", "last", "minimizer", "digest", "places", "whole")
                )
                first, last, whole = first.astype(np.int64), last.astype(np.int64), whole.astype(bool)
                count = np.where(whole, 1, last - first + 1)
                of = np.repeat(np.arange(len(first)), count)
                begin = _runs(first, count)
                end = np.where(whole[of], last[of], begin)
                inside = end - begin
                inner = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(inside)].astype(np.int32)), pa.array(nodes[_runs(begin + 1, inside)])
                )
                which = pa.array(np.full(len(of), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(which), batch.column("row_key").take(which), pa.array(minimizer[of]),
                     pa.array(digest[of]), pa.array((begin - first[of]).astype(np.int32)),
                     pa.array((end - first[of]).astype(np.int32)), pa.array(np.where(whole[of], digest[of], edges[begin])),
                     pa.array(whole[of]), pa.array(places[of]), pa.array(nodes[begin]), pa.array(nodes[end + 1]),
                     pa.array(least[begin]), pa.array(least[end + 1]), inner],
                    ["doc_id", "row_key", "minimizer", "digest", "from", "to", "name", "whole", "places", "head", "tail",
                     "head_seed", "tail_seed", "inner"],
                )

    return run


def _same_row(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.row_key") == F.col(f"{right}.row_key")
    )


def _classes(docs: DataFrame, workspace: Workspace, window: int, seed_words: int) -> tuple[DataFrame, DataFrame]:
    """Stretches whose minimizer is repeated, and their classes."""
    every = workspace.table(stretches(docs, window, seed_words), "stretches")
    repeated = every.groupBy("minimizer").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("minimizer")
    kept = workspace.table(every.join(repeated, "minimizer", "left_semi"), "repeated-stretches")
    workspace.drop(every)
    classes = kept.groupBy("minimizer", "digest").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("doc_id", "row_key", "first", "last")).alias("at")
    )
    return kept, workspace.table(classes, "classes")


def _segments(docs: DataFrame, classes: DataFrame, workspace: Workspace, window: int, seed_words: int) -> DataFrame:
    """Repeated segments as pieces of the classes that hold them: ``minimizer, digest, from, to, segment, head, tail, places, at``.

    ``from`` and ``to`` count windows from the start of the class; ``places`` counts all places of the segment; ``at`` is the
    document of its first one.  A segment that several classes hold has a row for each.
    """
    branching = classes.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(
        "minimizer", F.lit(False).alias("whole")
    )
    sorted_out = classes.join(branching, "minimizer", "left").withColumn("whole", F.coalesce("whole", F.lit(True)))
    parts = sorted_out.where("places > 1 OR NOT whole").groupBy("at.doc_id", "at.row_key").agg(
        F.collect_list(F.struct("at.first", "at.last", "minimizer", "digest", "places", "whole")).alias("parts")
    )
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + T._parse_datatype_string(
        "row_key bigint, minimizer bigint, digest bigint, from int, to int, name bigint, whole boolean, places bigint, "
        "head bigint, tail bigint, head_seed bigint, tail_seed bigint, inner array<bigint>"
    ).fields)
    sources = parts.alias("p").join(_packed(docs).alias("d"), _same_row("p", "d"))
    pieces = workspace.table(sources.select("p.*", "d.packed").mapInArrow(_cut(window, seed_words), schema), "pieces")
    at = F.struct("doc_id", "row_key")

    edges = pieces.where(~F.col("whole"))
    # repeated rows give their pieces twice, but all places were counted with the class; a class holds an edge once
    counted = edges.dropDuplicates(["minimizer", "name", "digest"]).groupBy("minimizer", "name").agg(
        F.sum("places").alias("places"), F.min(at).alias("at")
    ).where("places > 1")
    single = workspace.table(
        edges.drop("places").join(counted, ["minimizer", "name"]).select(
            "minimizer", "digest", "from", "to", F.xxhash64("minimizer", "name").alias("segment"), "head", "tail", "places",
            "at", "head_seed", "tail_seed",
        ), "single-edges",
    )
    # nodes at which a segment of another minimizer ends or starts
    whole = pieces.where("whole")
    ends = None
    for table in (single, whole):
        for side in ("head", "tail"):
            one = table.where(F.col(f"{side}_seed") != F.col("minimizer")).select(
                F.col(f"{side}_seed").alias("minimizer"), F.col(side).alias("node")
            )
            ends = one if ends is None else ends.unionByName(one)
    cuts = whole.select("minimizer", "digest", "inner").join(ends.distinct(), "minimizer").select(
        "minimizer", "digest", F.array_position("inner", F.col("node")).cast("int").alias("cut")
    ).where("cut > 0").groupBy("minimizer", "digest").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.col("to") + 1))
    cut = whole.join(cuts, ["minimizer", "digest"], "left").withColumn("bounds", bounds).select(
        "*", F.posexplode(F.slice("bounds", 1, F.size("bounds") - 1)).alias("nth", "begin")
    ).withColumn("end", F.col("bounds")[F.col("nth") + 1])
    cut = cut.select(
        "minimizer", "digest", F.col("begin").alias("from"), (F.col("end") - 1).alias("to"),
        F.xxhash64("minimizer", "digest", "begin").alias("segment"),
        F.when(F.col("begin") == 0, F.col("head")).otherwise(F.get("inner", F.col("begin") - 1)).alias("head"),
        F.when(F.col("end") > F.col("to"), F.col("tail")).otherwise(F.get("inner", F.col("end") - 1)).alias("tail"),
        "places", at.alias("at"),
    )
    segments = workspace.table(single.drop("head_seed", "tail_seed").unionByName(cut), "segments")
    workspace.drop(pieces)
    workspace.drop(single)
    return segments


def _compacted(segments: DataFrame, workspace: Workspace) -> DataFrame:
    """``segment, path`` for segments that nodes without a branch connect; every other segment is a path by itself.

    A task contracts the links of its documents to stars.  A segment has at most two links, so it is in at most two stars;
    only where these differ do their centres go to the star rounds.
    """
    distinct = segments.groupBy("segment").agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("at").alias("at"))
    none = F.lit(None).cast("bigint")
    touched = distinct.select("at", F.inline(F.array(
        F.struct(F.col("tail").alias("node"), F.col("segment").alias("enters"), none.alias("leaves")),
        F.struct(F.col("head").alias("node"), none.alias("enters"), F.col("segment").alias("leaves")),
    )))
    links = touched.groupBy("node").agg(
        F.count("enters").alias("ways_in"), F.count("leaves").alias("ways_out"), F.min("enters").alias("u"),
        F.min("leaves").alias("v"), F.min("at").alias("at"),
    ).where("ways_in = 1 AND ways_out = 1 AND u != v")
    stars = contracted_by(links, "at").select(F.explode(F.array(
        F.struct(F.col("u").alias("segment"), F.col("v").alias("centre")),
        F.struct(F.col("v").alias("segment"), F.col("v").alias("centre")),
    )).alias("s")).select("s.*")
    held = workspace.table(
        stars.groupBy("segment").agg(F.min("centre").alias("low"), F.max("centre").alias("high")), "stars"
    )
    joined = connected_components(held.where("low != high").select(F.col("low").alias("u"), F.col("high").alias("v")), workspace)
    return held.join(joined, F.col("low") == F.col("node"), "left").select(
        "segment", F.coalesce("component", "low").alias("path")
    )


def repeated_paths(
    docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, workspace: Workspace | None = None
) -> DataFrame:
    """Maximal nonbranching paths of the graph of repeated windows: ``path, n_edges, n_words, places``.

    ``n_edges`` are its distinct windows, ``n_words`` the words they cover in a row, ``places`` those of its most frequent window.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    _, classes = _classes(docs, workspace, window, seed_words)
    segments = _segments(docs, classes, workspace, window, seed_words)
    each = segments.groupBy("segment").agg(F.max("places").alias("places"), F.max(F.col("to") - F.col("from") + 1).alias("edges"))
    along = each.join(_compacted(segments, workspace), "segment", "left")
    return along.groupBy(F.coalesce("path", "segment").alias("path")).agg(
        F.sum("edges").alias("n_edges"), (F.sum("edges") + window - 1).alias("n_words"), F.max("places").alias("places")
    )


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, row_key, first, last, path``: runs of windows (first and last) of a document that follow one repeated path."""
    workspace = workspace or Workspace(docs.sparkSession)
    kept, classes = _classes(docs, workspace, window, seed_words)
    segments = _segments(docs, classes, workspace, window, seed_words)
    pieces = segments.join(_compacted(segments, workspace), "segment", "left").select(
        "minimizer", "digest", "from", "to", F.coalesce("path", "segment").alias("path")
    )
    # pieces of one path inside a class, at most as many as a window has minimizers
    along = Window.partitionBy("minimizer", "digest").orderBy("from")
    new = (F.lag("path").over(along) != F.col("path")) | (F.lag("to").over(along) + 1 < F.col("from"))
    pieces = pieces.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy("minimizer", "digest", "run").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.first("path").alias("path")
    )
    found = kept.join(workspace.table(pieces, "path-pieces"), ["minimizer", "digest"]).select(
        "doc_id", "row_key", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to")).alias("last"), "path"
    )
    # neighbours of one path are one span; equal rows give their pieces twice
    line = Window.partitionBy("doc_id", "row_key").orderBy("first", "last")
    new = (F.lag("path").over(line) != F.col("path")) | (F.lag("last").over(line) + 1 < F.col("first"))
    return found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy("doc_id", "row_key", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.first("path").alias("path")
    ).drop("run")


def repeated_ranges(
    docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, row_key, ranges``: the spans of ``repeated_spans`` by document."""
    workspace = workspace or Workspace(docs.sparkSession)
    spans = repeated_spans(docs, window, seed_words, workspace).groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges")
    )
    return workspace.table(spans, "ranges")


def _remove(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"kept": [], "n_words": [], "n_removed": [], "removed": []}
            ranges = batch.column("ranges").to_pylist()
            for packed, found in zip(batch.column("packed").to_pylist(), ranges):
                tokens = _unpack(packed)
                gone = np.zeros(len(tokens) + 1, np.int64)
                for r in found or ():
                    gone[r["first"]] += 1
                    gone[r["last"] + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                out["kept"].append(b" ".join([w for w, g in zip(tokens, gone) if not g]).decode())
                out["n_words"].append(len(tokens))
                out["n_removed"].append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
                out["removed"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["kept"], pa.string()), pa.array(out["n_words"], pa.int64()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], span)],
                ["doc_id", "kept", "n_words", "n_removed", "removed"],
            )

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, kept, n_words, n_removed, removed`` for every row: the text without words that a repeated window covers.

    Kept words are joined by one blank; ``removed`` has word ranges, end exclusive.  A null, empty or short text has
    no window and loses nothing.  Equal rows repeat each other's windows, so all copies of a passage go.
    """
    ranges = repeated_ranges(docs, window, seed_words, workspace)
    joined = _packed(docs).alias("d").join(ranges.alias("r"), _same_row("d", "r"), "left").select(
        "d.doc_id", "d.packed", "r.ranges"
    )
    span = "array<struct<start:bigint,end:bigint>>"
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("kept", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T._parse_datatype_string(span)),
    ])
    return joined.mapInArrow(_remove(window), schema)


def removal_report(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
