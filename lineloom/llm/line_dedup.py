"""Lines that many documents share: kept in one document, dropped from the others.

Built-in functions only.  Every document is cut into lines; the key of a line is its trimmed text in lower case.  Long
enough keys are hashed to 128 bits, counted once for each document, and those found in at least ``min_docs``
documents are joined back to their places.  The dropped places of a document (at most as many as it has lines) travel to its text,
which is put together again from the remaining positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.llm.rows import BLANKS, ascii_lower, row_key

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def shared_line_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Places to drop: ``doc_id``, ``row_key`` and the sorted line numbers ``dropped`` (from 0)."""
    split = docs.select("doc_id", row_key().alias("row_key"), F.split("text", "\n").alias("lines"))
    lines = split.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = lines.select(
        "doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )
    # one row for each key and document first, so that a line repeated inside a document counts once
    shared = (
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    places = lines.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return places.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Columns ``row`` (the input row), ``kept`` (the remaining text), ``n_lines`` before and ``n_dropped``.

    A null text counts as one empty line.  Rows that share a ``doc_id`` are one document when documents are counted;
    the keeper of a line is the largest id that holds it, and keeps every copy of the line.  Rows without an id are
    together one document, which never is the keeper.  Rows that repeat id and text each keep their row.
    """
    dropped = shared_line_places(docs, min_chars, min_docs).withColumnRenamed("doc_id", "its_id")
    dropped = dropped.withColumnRenamed("row_key", "its_key")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"),
        row_key().alias("own_key"),
    )
    joined = rows.join(
        dropped, F.col("own_id").eqNullSafe(F.col("its_id")) & (F.col("own_key") == F.col("its_key")), "left"
    )
    text = F.coalesce(F.col("row.text"), F.lit(""))
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    lines = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("dropped").isNull(), text).otherwise(kept).alias("kept"),
        count.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def line_report(done: DataFrame) -> DataFrame:
    """One digest row for each document."""
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def with_kept_text(done: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns, the text replaced by the kept lines; ``n_chars`` follows where there is one."""
    out = []
    for c in columns:
        if c == "text":
            out.append(F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("n_dropped") > 0, F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return done.select(*out)
