"""Near copies by MinHash, banding and confirmation on full shingle sets.

1. One pass over the texts: shingle set of each document, minima of ``bands * rows`` universal hash functions, one key for each
   band of ``rows`` minima, a byte of each minimum as signature, the packed words.  Documents with equal sets
   form a class, represented by one row from here on.
2. Classes that share a band key are candidates.  A bucket hangs on its smallest class (never on all pairs), and connected
   buckets form a *family*.
3. Inside a family, every set is compared with that of a *hub*, the class in the fullest buckets, and reduced to its
   difference ``D = set ^ hub``.  Then ``|x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|``, and the threshold says how many elements
   of ``Dx`` and ``Dy`` a linked pair must share.  Where both link with the hub, they are connected already.  Every
   other link shares one of the rarest elements of its differences (a prefix filter), so these elements are the
   join key.  An element held by more than ``direct`` of them makes a smaller family with a hub of its own,
   and the step is repeated.
4. Pairs found that way pass the signature check and are confirmed on the full sets; components come from
   large-star and small-star rounds.

Beyond the chance that two sets never share a band key (below 1e-6 at the threshold with the default bands), no link
between different sets is lost, and a family of any size costs about its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lineloom.llm.components import connected_components
from lineloom.llm.rows import as_int64, distinct_sorted, lower_words, text_chunks, window_hashes, word_hashes
from lineloom.workspace import Workspace

SHINGLE = 5
PERCENT = 85  # linked: 100 * |x & y| >= PERCENT * |x | y|
BANDS = 42
ROWS = 7
DIRECT = 200
SEED = 20_240_501
_U = np.uint64


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions of 64 bits onto 32."""
    draw = np.random.default_rng(SEED)
    odd = draw.integers(0, 2**63, count, dtype=np.uint64) * _U(2) + _U(1)
    return odd, draw.integers(0, 2**63, count, dtype=np.uint64)


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of one document's word hashes; short texts are one shingle."""
    if not len(hashes):
        return hashes
    return distinct_sorted(window_hashes(hashes, min(size, len(hashes))))


def minima(shingles: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out = np.full(len(odd), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 256):  # a block that stays in the processor's cache
        part = shingles[at:at + 256]
        values = (part[None, :] * odd[:, None] + shift[:, None]) >> _U(32)
        out = np.minimum(out, values.min(axis=1).astype(np.uint32))
    return out


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, shift = _hash_family(bands * rows)
        weights = _hash_family(rows)[0]
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, tokens, counts in text_chunks(texts, lower_words):
                hashes, ends = word_hashes(tokens), np.cumsum(counts)
                out: dict[str, list] = {"n": [], "digest": [], "bands": [], "signature": [], "packed": []}
                for i, (count, end) in enumerate(zip(counts, ends)):
                    shingles = shingle_set(hashes[end - count:end], size)
                    out["n"].append(len(shingles))
                    if not len(shingles):
                        for name in ("digest", "bands", "signature", "packed"):
                            out[name].append(None)
                        continue
                    low = minima(shingles, odd, shift)
                    keys = (low.reshape(bands, rows).astype(_U) * weights).sum(axis=1)
                    out["digest"].append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    out["bands"].append(as_int64(keys))
                    out["signature"].append(low.astype(np.uint8).tobytes())
                    out["packed"].append(packer.compress(b" ".join(tokens[end - count:end])))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(counts)), pa.array(out["n"], pa.int64()), pa.array(out["digest"], pa.binary()),
                     pa.array(out["bands"], pa.list_(pa.int64())), pa.array(out["signature"], pa.binary()),
                     pa.array(out["packed"], pa.binary())],
                    ["doc_id", "n", "digest", "bands", "signature", "packed"],
                )

    return run


def sketches(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("signature", T.BinaryType()), T.StructField("packed", T.BinaryType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(_sketch(size, bands, rows), schema)


# ---------------------------------------------------------------------------------------------------------------
# Differences from a hub


def _most_apart(total, percent: int):
    """Largest ``|x ^ y|`` of a linked pair with ``|x| + |y| = total``: ``100 (u - h) >= percent u``, ``2u = total + h``."""
    return (100 - percent) * total // (100 + percent)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return shingle_set(word_hashes(zstandard.decompress(packed).split(b" ")), size)


def _differences(size: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes | None, np.ndarray] = (None, np.empty(0, _U))
        for batch in batches:
            packed, hubs = batch.column("packed").to_pylist(), batch.column("hub_packed").to_pylist()
            apart, linked = [], []
            for own, hub in zip(packed, hubs):
                if known[0] != hub:
                    known = (hub, _unpack(hub, size))
                mine, its = _unpack(own, size), known[1]
                difference = np.setxor1d(mine, its, assume_unique=True)
                linked.append(bool(len(difference) <= _most_apart(len(mine) + len(its), percent)))
                apart.append(as_int64(difference))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("family", "node", "n", "hub", "hub_n", "signature")]
                + [pa.array(apart, pa.list_(pa.int64())), pa.array(linked, pa.bool_())],
                ["family", "node", "n", "hub", "hub_n", "signature", "apart", "linked"],
            )

    return run


def _prefix_lengths(members: DataFrame, percent: int) -> DataFrame:
    """How many of its rarest elements a class has to offer, to unlinked partners (``short``, ``near``) and to linked ones (``far``).

    ``h`` is the most that the class and any partner in its family may differ by, so ``|Dx & Dy| >= (|Dx| + |Dy| - h) / 2``.  An unlinked
    partner has no smaller difference where the class is the smaller one of the pair (``short``); where it is the larger
    one, a difference of ``least`` elements in the family and of ``|Dx| - h`` at least (``near``).  An unlinked class shares ``|Dx| - h`` or more
    with a linked one.  Sets that share ``o`` elements share one of their ``|D| - o + 1`` rarest.
    """
    sizes = members.groupBy("family").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.when(~F.col("linked"), F.size("apart"))).alias("least")
    )
    size = F.size("apart")
    largest = F.least(F.floor(F.col("n") * 100 / percent), F.col("high"))
    h = F.floor((F.col("n") + largest) * (100 - percent) / (100 + percent))

    def offered(shared: F.Column) -> F.Column:
        return F.greatest(F.lit(0), size - F.greatest(F.lit(1), shared) + 1).cast("int")

    unlinked = F.when(~F.col("linked"), 1).otherwise(0)
    known = members.join(sizes, "family")
    return known.select(
        *members.columns, size.alias("size"),
        (unlinked * offered(F.ceil(size - h / 2))).alias("short"),
        offered(F.ceil((size + F.greatest("least", size - h) - h) / 2)).alias("near"),
        (unlinked * offered(size - h)).alias("far"),
    )


def _rarest(members: DataFrame) -> DataFrame:
    """The rarest elements of each difference, rarity counted in the family, with their ``place`` among all its elements from 1 on.

    ``shorter`` and ``longer`` mark those to compare with unlinked classes, as the smaller and as the larger one of a pair; the others meet linked
    classes only.
    """
    elements = members.select("family", "node", F.explode("apart").alias("element"))
    counts = elements.groupBy("family", "element").agg(F.count(F.lit(1)).alias("holders"))
    # an element that one class alone holds joins nothing, but takes a place among the rarest
    shared = counts.where(F.col("holders") > 1)
    ranked = elements.join(shared, ["family", "element"]).groupBy("family", "node").agg(
        F.array_sort(F.collect_list(F.struct("holders", "element"))).alias("known")
    )
    alone = F.size("apart") - F.size("known")
    places = members.join(ranked, ["family", "node"]).select(
        "family", "node", "linked", "n", "size", "short", "near", alone.alias("alone"),
        F.posexplode(
            F.slice("known", F.lit(1), F.greatest(F.lit(0), F.greatest("near", "far") - alone))
        ).alias("at", "e"),
    )
    place = F.col("alone") + F.col("at") + 1
    return places.select(
        "family", "node", "linked", "n", "size", F.col("e.element").alias("element"), place.alias("place"),
        (place <= F.col("short")).alias("shorter"), (place <= F.col("near")).alias("longer"),
    )


def _confirm(percent: int, bytes_: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("apart_a"), batch.column("apart_b")
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one = np.frombuffer(batch.column("signature_a")[i].as_py(), np.uint8)
                two = np.frombuffer(batch.column("signature_b")[i].as_py(), np.uint8)
                # equal minima of a linked pair: percent of them on average, less by 7 deviations at most
                share = percent / 100
                if (one == two).mean() < share - 7 * np.sqrt(share * (1 - share) / bytes_):
                    continue
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                differ = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = differ <= _most_apart(na[i] + nb[i], percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])

    return run


def _with_hubs(families: DataFrame, store: DataFrame, size: int, percent: int) -> DataFrame:
    """Each class of ``families(family, node, fullness)`` beside the hub of its family, with the difference of both."""
    hubs = families.groupBy("family").agg(F.max_by("node", F.struct("fullness", -F.col("node"))).alias("hub"))
    hub_store = store.select(
        F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("packed").alias("hub_packed")
    )
    hubs = hubs.join(hub_store, "hub")
    rows = families.select("family", "node").join(hubs, "family").where(F.col("node") != F.col("hub"))
    rows = rows.join(store, "node").select("family", "node", "n", "signature", "packed", "hub", "hub_n", "hub_packed")
    schema = T.StructType([
        T.StructField("family", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("hub", T.LongType()), T.StructField("hub_n", T.LongType()),
        T.StructField("signature", T.BinaryType()), T.StructField("apart", T.ArrayType(T.LongType())),
        T.StructField("linked", T.BooleanType()),
    ])
    return rows.mapInArrow(_differences(size, percent), schema)


def _links(
    families: DataFrame, store: DataFrame, workspace: Workspace, size: int, percent: int, direct: int, signature: int
) -> DataFrame:
    """All links inside the families, less those between two classes that both link with a hub."""
    found = None
    while True:
        members = workspace.table(_prefix_lengths(_with_hubs(families, store, size, percent), percent), "differences")
        links = members.where("linked").select(F.col("hub").alias("u"), F.col("node").alias("v"))
        found = links if found is None else found.unionByName(links)
        open_ = members.where(~F.col("linked")).select("family").distinct()
        if open_.isEmpty():
            return found
        index = workspace.table(_rarest(members.join(open_, "family", "left_semi")), "rarest")
        linked = F.col("linked")
        shorter, longer = F.col("shorter") & ~linked, F.col("longer") & ~linked
        groups = index.groupBy("family", "element").agg(
            F.count_if(shorter).alias("short_n"), F.count_if(longer).alias("long_n"), F.count_if(~linked).alias("open_n"),
            F.count_if(linked).alias("linked_n"), F.min("node").alias("least"),
        )
        groups = groups.withColumn("inner", (F.col("short_n") > 0) & (F.col("long_n") > 1)).withColumn(
            "outer", (F.col("open_n") > 0) & (F.col("linked_n") > 0)
        ).where("inner OR outer")
        groups = workspace.table(groups.select(
            "family", "element", "least", "inner", "outer",
            (F.col("inner") & (F.least("short_n", "long_n") > direct)).alias("inner_crowd"),
            (F.col("outer") & (F.least("open_n", "linked_n") > direct)).alias("outer_crowd"),
        ), "groups")
        wanted = groups.where("(inner AND NOT inner_crowd) OR (outer AND NOT outer_crowd)").select(
            "family", "element", F.expr("inner AND NOT inner_crowd").alias("inner"),
            F.expr("outer AND NOT outer_crowd").alias("outer"),
        )
        few = index.join(wanted, ["family", "element"])
        left = few.where(~linked).alias("a")
        on = (F.col("a.family") == F.col("b.family")) & (F.col("a.element") == F.col("b.element"))
        meet = (F.col("b.linked") & F.col("a.outer")) | (
            ~F.col("b.linked") & F.col("a.inner") & F.col("a.shorter") & F.col("b.longer")
            & (F.struct("a.size", "a.node") < F.struct("b.size", "b.node"))
        )
        alike = (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
        # at the first element that both hold, no more than the shorter rest can follow
        rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
        apart = F.floor((F.col("a.n") + F.col("b.n")) * (100 - percent) / (100 + percent))
        enough = 2 * (rest + 1) >= F.col("a.size") + F.col("b.size") - apart
        pairs = left.join(few.alias("b"), on & meet & alike & enough).select(
            F.col("a.family").alias("family"), F.col("a.node").alias("u"), F.col("b.node").alias("v")
        ).distinct()

        def side(name: str, node: str) -> DataFrame:
            return members.select(
                "family", F.col("node").alias(node), F.col("n").alias(f"n_{name}"),
                F.col("apart").alias(f"apart_{name}"), F.col("signature").alias(f"signature_{name}"),
            )

        pairs = pairs.join(side("a", "u"), ["family", "u"]).join(side("b", "v"), ["family", "v"])
        confirmed = pairs.mapInArrow(_confirm(percent, signature), "u bigint, v bigint")
        found = found.unionByName(workspace.table(confirmed, "confirmed"))
        crowded = groups.where("inner_crowd OR outer_crowd").drop("inner", "outer")
        if crowded.isEmpty():
            return found
        inside = index.join(crowded, ["family", "element"]).where("outer_crowd OR (longer AND NOT linked)")
        inside = workspace.table(inside.select("family", "node", "least"), "crowded")
        named = inside.select(
            "node", F.col("least").alias("u"), F.col("node").alias("v")
        ).distinct()
        part = connected_components(named.select("u", "v"), workspace)
        families = inside.groupBy("node").agg(F.count(F.lit(1)).alias("fullness")).join(part, "node").select(
            F.col("component").alias("family"), "node", "fullness"
        )
        families = workspace.table(families, "families")


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    direct: int = DIRECT,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A null or empty text has no shingle and is a component of its own, as is a row without an id (unless its set equals
    another row's).  Rows that repeat an id are one document and share a component; ``kept`` is then true for all
    of them.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark)
    sketch = workspace.table(sketches(docs, size, bands, rows), "sketches")
    known = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # a class is named by its smallest id, unless that is the smallest of another class too
    texts = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    texts = workspace.table(texts.select(F.col("doc_id").alias("several")), "several")
    unique = texts.isEmpty()
    if unique:
        classes = classes.withColumn("node", F.col("first"))
    else:
        turn = F.row_number().over(Window.partitionBy("first").orderBy("digest"))
        classes = classes.withColumn("node", F.when(turn == 1, F.col("first")).otherwise(F.xxhash64("digest")))
    classes = workspace.table(classes, "classes")
    # one row for each class; rows that repeat its id and digest have the same set, so any of them will do
    one = sketch.join(
        classes.withColumnRenamed("digest", "its"), (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("its"))
    )
    band_rows = one.select("node", F.posexplode("bands").alias("band", "key")).select(
        "node", F.xxhash64("band", "key").alias("key")
    )
    buckets = band_rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    buckets = buckets.where(F.col("size") > 1)
    stars = workspace.table(
        band_rows.join(buckets, "key").groupBy("node", "least").agg(F.sum("size").alias("fullness")), "stars"
    )
    parts = connected_components(stars.select(F.col("least").alias("u"), F.col("node").alias("v")), workspace)
    families = stars.groupBy("node").agg(F.sum("fullness").alias("fullness")).join(parts, "node").select(
        F.col("component").alias("family"), "node", "fullness"
    )
    families = workspace.table(families, "families")
    in_family = families.select("node")
    store = workspace.table(
        one.select("node", "n", "signature", "packed").join(in_family, "node", "left_semi").dropDuplicates(["node"]),
        "members",
    )
    links = _links(families, store, workspace, size, percent, direct, bands * rows)
    if not unique:
        own = known.join(texts, F.col("doc_id") == F.col("several")).join(classes, "digest").select("doc_id", "node").distinct()
        centre = own.groupBy("doc_id").agg(F.min("node").alias("u"))
        links = links.unionByName(own.join(centre, "doc_id").select("u", F.col("node").alias("v")))
    linked = connected_components(links, workspace)
    named = classes.join(linked, "node", "left").select(
        F.col("digest").alias("its"), "first", F.coalesce("component", "node").alias("component")
    )
    if not unique:
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        named = named.join(least, "component").select("its", F.col("least").alias("component"))
    named = named.select("its", "component")
    done = sketch.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("its"), "left")
    component = F.coalesce("component", "doc_id")
    return done.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns as they are, without those that another document of their component stands for."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
