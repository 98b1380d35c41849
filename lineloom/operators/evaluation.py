"""Accuracy of parsed templates against labelled ones.

One join on ``LineId`` and one ``groupBy(truth, parsed).count()`` reduce the lines to the table of template pairs; all
metrics are aggregates of that table.  No metric gathers the pairs of a template: each uses counts, minima and sums
that combine before the shuffle, so one template that holds most lines or most pairs is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.text import lenient_template_equal
from lineloom.workspace import Workspace

TEMPLATE = "EventTemplate"


def valid_rows(truth: DataFrame, parsed: DataFrame, column: str = TEMPLATE) -> DataFrame:
    """``LineId, Truth, Parsed`` of the lines that have a label."""
    labelled = truth.where(F.col(column).isNotNull()).select("LineId", F.col(column).alias("Truth"))
    return labelled.join(parsed.select("LineId", F.col(column).alias("Parsed")), "LineId")


def template_pairs(truth: DataFrame, parsed: DataFrame, column: str = TEMPLATE) -> DataFrame:
    """``Truth, Parsed, n``: what every metric starts from."""
    return valid_rows(truth, parsed, column).groupBy("Truth", "Parsed").agg(F.count(F.lit(1)).alias("n"))


def _listed(column: Column, wanted: Sequence[str] | DataFrame | None, df: DataFrame) -> DataFrame:
    """Add ``Listed``: is the value among the wanted templates?  All are when none are given."""
    if wanted is None:
        return df.withColumn("Listed", F.lit(True))
    if isinstance(wanted, DataFrame):
        names = wanted.select(F.col(wanted.columns[0]).alias("__wanted")).distinct()
        return df.join(names, column == F.col("__wanted"), "left").withColumn(
            "Listed", F.col("__wanted").isNotNull()
        ).drop("__wanted")
    return df.withColumn("Listed", F.coalesce(column.isin(list(wanted)), F.lit(False)))


def _list_size(wanted: Sequence[str] | DataFrame) -> int:
    return wanted.count() if isinstance(wanted, DataFrame) else len(wanted)


def _harmonic(p: Column, r: Column) -> Column:
    return F.when((p != 0) | (r != 0), F.try_divide(p * r * 2.0, p + r)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def grouping_counts(pairs: DataFrame, wanted: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """One row of counts behind F2 and F3.

    A labelled template is accurate when its lines carry exactly one parsed template and that template has just as
    many lines.  Lines without a parsed template count in the sizes, and nowhere else.
    """
    truth = _listed(
        F.col("Truth"), wanted,
        pairs.groupBy("Truth").agg(
            F.sum("n").alias("Size"), F.count("Parsed").alias("Kinds"), F.max("Parsed").alias("Parsed")
        ),
    )
    totals = truth.agg(
        F.sum(F.when(F.col("Listed"), F.col("Size")).otherwise(0)).alias("Lines"),
        F.count(F.lit(1)).alias("TruthTemplates"),
    )
    # one row per (parsed template, size): both sides of the join below are unique
    single = (
        truth.where((F.col("Kinds") == 1) & F.col("Listed"))
        .groupBy("Parsed", "Size").agg(F.count(F.lit(1)).alias("Templates"))
    )
    seen = pairs.where(F.col("Parsed").isNotNull())
    if wanted is None:
        sizes = seen.groupBy("Parsed").agg(F.sum("n").alias("Size"))
        parsed_total = sizes.agg(F.count(F.lit(1)).alias("ParsedTemplates"))
    else:
        sizes = _listed(F.col("Truth"), wanted, seen).groupBy("Parsed").agg(
            F.sum("n").alias("Size"), F.max("Listed").alias("Touched")
        )
        parsed_total = sizes.agg(F.count_if("Touched").alias("ParsedTemplates"))
    accurate = single.join(sizes, ["Parsed", "Size"]).agg(
        F.coalesce(F.sum("Templates"), F.lit(0)).alias("AccurateTemplates"),
        F.coalesce(F.sum(F.col("Templates") * F.col("Size")), F.lit(0)).alias("AccurateLines"),
    )
    row = _one_row(totals, parsed_total, accurate)
    if wanted is not None:
        row = row.withColumn("TruthTemplates", F.lit(_list_size(wanted)).cast("bigint"))
    return row


def _one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row results side by side: as rows of one union, then one aggregate."""
    names = [c for part in parts for c in part.columns]
    stacked = None
    for part in parts:
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in names])


def grouping_accuracy(pairs: DataFrame, wanted: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """``GA, PGA, RGA, FGA``."""
    row = grouping_counts(pairs, wanted).select(
        _ratio(F.col("AccurateLines"), F.col("Lines")).alias("GA"),
        _ratio(F.col("AccurateTemplates"), F.col("ParsedTemplates")).alias("PGA"),
        _ratio(F.col("AccurateTemplates"), F.col("TruthTemplates")).alias("RGA"),
    )
    return row.withColumn("FGA", _harmonic(F.col("PGA"), F.col("RGA")))


def template_accuracy(pairs: DataFrame, wanted: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """``Identified, GroundTruth, FTA, PTA, RTA``.

    A parsed template is right when all its lines are labelled with exactly that text.
    """
    seen = _listed(F.col("Truth"), wanted, pairs.where(F.col("Parsed").isNotNull()))
    groups = seen.groupBy("Parsed").agg(
        F.min("Truth").alias("Lowest"), F.max("Truth").alias("Highest"), F.max("Listed").alias("Touched")
    )
    # the only label is the parsed text itself, so "its text is listed" equals "a listed label touches it"
    right = (F.col("Lowest") == F.col("Parsed")) & (F.col("Highest") == F.col("Parsed")) & F.col("Touched")
    parsed_side = groups.agg(F.count_if("Touched").alias("Identified"), F.count_if(right).alias("Right"))
    if wanted is None:
        truth_side = pairs.groupBy("Truth").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("GroundTruth"))
        row = _one_row(parsed_side, truth_side)
    else:
        row = parsed_side.withColumn("GroundTruth", F.lit(_list_size(wanted)).cast("bigint"))
    row = row.select(
        "Identified", "GroundTruth",
        _ratio(F.col("Right"), F.col("Identified")).alias("PTA"),
        _ratio(F.col("Right"), F.col("GroundTruth")).alias("RTA"),
    )
    return row.select(
        "Identified", "GroundTruth", _harmonic(F.col("PTA"), F.col("RTA")).alias("FTA"), "PTA", "RTA"
    )


def _share(pairs: DataFrame, equal: Column, wanted, name: str) -> DataFrame:
    rows = _listed(F.col("Truth"), wanted, pairs).where("Listed")
    hits = F.sum(F.when(equal, F.col("n")).otherwise(0))
    return rows.agg(_ratio(hits, F.sum("n")).alias(name))


def parsing_accuracy(pairs: DataFrame, wanted: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """share of lines whose parsed template equals the label."""
    return _share(pairs, F.col("Truth") == F.col("Parsed"), wanted, "PA")


def parsing_accuracy_lenient(pairs: DataFrame, wanted: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """the same under C9."""
    equal = F.coalesce(lenient_template_equal(F.col("Truth"), F.col("Parsed")), F.lit(False))
    return _share(pairs, equal, wanted, "PA")


def exact_match_accuracy(pairs: DataFrame) -> DataFrame:
    """share of lines with equal strings, where a missing template reads ``nan``."""
    return _share(
        pairs, F.coalesce("Truth", F.lit("nan")) == F.coalesce("Parsed", F.lit("nan")), None, "ExactMatch"
    )


def evaluate(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """one row ``GA, FGA, FTA, PTA, RTA``."""
    return evaluate_full(truth, parsed).drop("PA")


def evaluate_full(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """one row ``GA, PA, FGA, FTA, PTA, RTA``."""
    # several small aggregates read the pairs, so the join of the lines is done once
    pairs = Workspace(truth.sparkSession).table(template_pairs(truth, parsed), "template-pairs")
    return metric_row(pairs)


def metric_row(pairs: DataFrame) -> DataFrame:
    row = _one_row(
        grouping_accuracy(pairs).select("GA", "FGA"),
        parsing_accuracy_lenient(pairs),
        template_accuracy(pairs).select("FTA", "PTA", "RTA"),
    )
    return row.select("GA", "PA", "FGA", "FTA", "PTA", "RTA")
