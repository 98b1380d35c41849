"""Reading raw lines and numbering them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lineloom.functions.regex import strip_blanks
from lineloom.sources.formats import NON_ASCII_MARK, compile_log_format, parse_log_lines, require_loaded
from lineloom.workspace import Workspace

MESSAGE_SCHEMA = "message string"
_SPLIT = ("SourceFile", "SplitStart")


def read_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A1: one row per line, with the file and the split it comes from."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # split sizes must not follow the cluster size: numbering reads the files twice
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    raw = spark.read.text(path if isinstance(path, str) else list(path))
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("SourceFile"),
        F.col("_metadata.file_block_start").alias("SplitStart"),
    )


def with_line_id(lines: DataFrame, per_file: bool = False) -> DataFrame:
    """A2: dense 1-based ``LineId`` in file and line order, without moving a line.

    Filter first for the numbering of matched lines, number first for physical line numbers.  Inside a task the rows
    of a split are consecutive, so ``monotonically_increasing_id`` minus the split's smallest value is the place in
    the split.  One counting job yields one small row per split; its running sum is the only global step.
    ``per_file`` restarts at 1 in every file.
    """
    spark = lines.sparkSession
    tagged = lines.withColumn("__mid", F.monotonically_increasing_id())
    splits = Workspace(spark).table(
        tagged.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("__mid").alias("low")), "splits"
    )
    order = (Window.partitionBy("SourceFile") if per_file else Window.partitionBy()).orderBy(*_SPLIT)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = Workspace(spark).table(
        splits.select(*_SPLIT, (F.coalesce(before, F.lit(0)) - F.col("low") + 1).alias("__shift")), "offsets"
    )
    numbered = tagged.join(offsets, list(_SPLIT)).withColumn("LineId", F.col("__mid") + F.col("__shift"))
    return numbered.select("LineId", *lines.columns)


def load_log(spark: SparkSession, path: str | Sequence[str], log_format: str, check: bool = True) -> DataFrame:
    """A5: physical line numbers, blank lines dropped, every run of non-ASCII characters marked."""
    fmt = compile_log_format((log_format or "").strip())
    numbered = with_line_id(read_log_lines(spark, path), per_file=True)
    loaded = parse_log_lines(mark_non_ascii(numbered), fmt, keep=("SourceFile", "LineId"))
    return require_loaded(loaded, log_format) if check else loaded


def mark_non_ascii(lines: DataFrame, column: str = "value") -> DataFrame:
    """The text step of A5 on any table of lines."""
    line = strip_blanks(F.col(column))
    return (
        lines.withColumn(column, line)
        .where(F.col(column) != "")
        .withColumn(column, F.regexp_replace(F.col(column), r"[^\x00-\x7F]+", NON_ASCII_MARK))
    )


def read_messages(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """Records with one ``message`` field; ``avro`` needs the spark-avro package on the class path."""
    if source_format not in ("json", "parquet", "avro", "orc"):
        raise ValueError(f"unknown record format {source_format!r}")
    return spark.read.schema(MESSAGE_SCHEMA).format(source_format).load(path)
