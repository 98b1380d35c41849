"""Structured logs and template tables as files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lineloom.functions.correction import correct_templates

# Fixed value: how a structured result file is named after its data set.
STRUCTURED_SUFFIX = "_2k.log_structured.csv"

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
_EMPTY = "\u0002"
# the writer would trim fields by default
_CSV_OUT = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None) -> DataFrame:
    # a quoted empty field is an empty string, an unquoted one is NULL; the reader alone would make both NULL
    reader = spark.read.options(**_CSV, emptyValue=_EMPTY)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", False)
    df = reader.csv(path if isinstance(path, str) else list(path))
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({name: F.when(F.col(f"`{name}`") != _EMPTY, F.col(f"`{name}`")).when(
        F.col(f"`{name}`").isNotNull(), F.lit("")) for name in texts})


def read_structured_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """A structured log; every column is a string unless ``schema`` says otherwise."""
    return _read_csv(spark, path, schema)


def read_templates_csv(spark: SparkSession, path: str | Sequence[str], occurrences: bool = False) -> DataFrame:
    """A template table or a ground-truth template list."""
    schema = "EventId string, EventTemplate string" + (", Occurrences bigint" if occurrences else "")
    return _read_csv(spark, path, schema)


def write_structured(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet keeps the parameter array; CSV gets it as JSON text."""
    if file_format == "csv":
        arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
        df = df.withColumns({name: F.to_json(name) for name in arrays})
        df.write.mode(mode).options(**_CSV_OUT).csv(path)
    else:
        df.write.mode(mode).format(file_format).save(path)


def write_templates(df: DataFrame, path: str, file_format: str = "csv", mode: str = "errorifexists") -> None:
    """A10: ``EventId, EventTemplate, Occurrences``."""
    table = df.select("EventId", "EventTemplate", "Occurrences")
    if file_format == "csv":
        table.write.mode(mode).options(**_CSV_OUT).csv(path)
    else:
        table.write.mode(mode).format(file_format).save(path)


def correct_templates_batch(
    spark: SparkSession, in_dir: str, names: Sequence[str], out_dir: str, mode: str = "errorifexists"
) -> DataFrame:
    """Correct the template column of the structured file of every named data set that is there.

    The files differ in their columns, so each is read and written by itself; what comes back is the corrected
    template of every row with its ``Dataset``.
    """
    parts = []
    for name in names:
        try:
            source = _read_csv(spark, f"{in_dir}/{name}{STRUCTURED_SUFFIX}", None)
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        target = f"{out_dir}/{name}{STRUCTURED_SUFFIX.removesuffix('.csv')}_modified.csv"
        correct_templates(source).write.mode(mode).options(**_CSV_OUT).csv(target)
        parts.append(_read_csv(spark, target, None).select(F.lit(name).alias("Dataset"), "EventTemplate"))
    if not parts:
        return spark.createDataFrame([], "Dataset string, EventTemplate string")
    return reduce(DataFrame.unionByName, parts)
