"""Parameters of a message under its template.

A template is cut at its wildcards into literals.  The first and the last one stand at the ends of the message; a fold over those between looks for each
behind the one before.  The earliest places are the right ones: whatever follows an earlier place could only begin earlier.  So
nothing is ever tried twice, and a message that does not fit costs no more than one that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.masking import WILDCARD
from lineloom.functions.regex import BLANKS

# Fixed pattern: a short text between angle brackets stands for any value.
BRACKETED = "(?d)<.{1,5}>"

_SPAN = "array<struct<a:int,b:int>>"


def _spaces(text: Column) -> Column:
    """Every blank as a space; positions stay."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def with_literals(templates: DataFrame, collapse_wildcards: bool = True) -> DataFrame:
    """Add the literals around the wildcards of ``EventTemplate``, their blanks as single spaces.

    With ``collapse_wildcards`` any short text between angle brackets is one wildcard, so ``<*> <*>`` yields a single
    value; without it every ``<*>`` yields its own.
    """
    template = F.col("EventTemplate")
    if collapse_wildcards:
        template = F.regexp_replace(template, BRACKETED, WILDCARD)
    single = F.regexp_replace(_spaces(template), " +", " ")
    return templates.withColumn("ParameterLiterals", F.split(single, r"<\*>"))


def _blanks_before(end: Column) -> Column:
    head = F.left("__single", end)
    return F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))


def _shared(literal: Column, at: Column) -> Column:
    """May ``literal`` begin in the run of blanks in which the one before ends?  It may if the run has two."""
    run = F.get("__runs", _blanks_before(at) - 1)
    return (
        F.col("__runs").isNotNull() & (at > 0) & F.startswith(literal, F.lit(" ")) & (F.substr("__single", at, F.lit(1)) == " ")
        & (run > 1)
    )


def _spans() -> Column:
    """Begin and end of every value in ``__single``; null where the message does not fit."""
    literals, single = F.col("ParameterLiterals"), F.col("__single")
    first, last = F.get(literals, F.lit(0)), F.get(literals, F.size(literals) - 1)
    stop = F.length(single) - F.length(last)
    start = F.struct(F.length(first).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def find(state: Column, literal: Column) -> Column:
        at = state["at"]
        place = F.when(literal == "", at + 1).otherwise(F.position(literal, single, at + 1))
        place = F.when((place == 0) & _shared(literal, at), at).otherwise(place)
        span = F.struct(at.alias("a"), F.greatest(at, place - 1).alias("b"))
        behind = F.when((at >= 0) & (place > 0), place - 1 + F.length(literal)).otherwise(F.lit(-1))
        return F.struct(behind.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def finish(state: Column) -> Column:
        at = state["at"]
        span = F.array(F.struct(at.alias("a"), F.greatest(at, stop).alias("b")))
        fits = (at <= stop) | ((at == stop + 1) & _shared(last, at))
        return F.when((at >= 0) & fits, F.concat(state["spans"], span))

    between = F.slice(literals, F.lit(2), F.greatest(F.size(literals) - 2, F.lit(0)))
    ends = F.startswith(single, first) & F.endswith(single, last)
    return F.when((F.size(literals) > 1) & ends, F.aggregate(between, start, find, finish))


def with_parameters(df: DataFrame, column: str = "Content") -> DataFrame:
    """``ParameterList`` for rows that carry ``ParameterLiterals`` (which goes); empty without a match.

    A blank of the template stands for a run of blanks, a value holds no newline, and a newline at the message's end does not count.  Neighbouring
    literals may share a run of two or more blanks around an empty value.
    """
    literals = F.col("ParameterLiterals")
    open_end = ~F.endswith(F.get(literals, F.size(literals) - 1), F.lit(" "))
    text = F.when(open_end & F.endswith(F.col(column), F.lit("\n")), F.expr(f"left(`{column}`, length(`{column}`) - 1)"))
    df = df.withColumn("__text", F.when(F.size(literals) > 1, F.coalesce(text, F.col(column))))
    df = df.withColumn("__spaced", _spaces(F.col("__text")))
    wide = F.contains("__spaced", F.lit("  "))
    df = df.withColumns({
        "__single": F.when(wide, F.regexp_replace("__spaced", " +", " ")).otherwise(F.col("__spaced")),
        "__runs": F.when(wide, F.transform(F.regexp_extract_all("__spaced", F.lit("( +)")), lambda run: F.length(run))),
    })
    df = df.withColumn("__spans", _spans())

    def hidden(end: Column) -> Column:
        """Characters of the message before ``end`` that ``__single`` leaves out."""
        runs = F.slice("__runs", F.lit(1), _blanks_before(end))
        return F.aggregate(runs, F.lit(0), lambda total, run: total + run - 1)

    def value(span: Column) -> Column:
        return F.substr("__text", span["a"] + 1, span["b"] - span["a"])

    def value_among_runs(span: Column) -> Column:
        a = span["a"] + hidden(span["a"])
        return F.when(span["b"] <= span["a"], "").otherwise(F.substr("__text", a + 1, span["b"] + hidden(span["b"]) - a))

    values = F.when(F.col("__runs").isNull(), F.transform("__spans", value)).otherwise(F.transform("__spans", value_among_runs))
    df = df.withColumn("__values", values)
    broken = F.contains("__text", F.lit("\n")) & F.exists("__values", lambda v: F.contains(v, F.lit("\n")))
    nothing = F.array().cast("array<string>")
    found = F.when(F.col("__values").isNull() | broken, nothing).otherwise(F.col("__values"))
    return df.withColumn("ParameterList", found).drop(
        "ParameterLiterals", "__text", "__spaced", "__single", "__runs", "__spans", "__values"
    )


def extract_parameters(df: DataFrame, collapse_wildcards: bool = True, column: str = "Content") -> DataFrame:
    """D7 for any table with ``EventTemplate`` and a message column; the literals are cut per row here."""
    return with_parameters(with_literals(df, collapse_wildcards), column)
