"""Template correction (E1): a fixed chain of ``regexp_replace``, without loops.

Each fixpoint rule of the form "replace ``<*>X<*>`` until nothing changes" equals one greedy match of the whole run;
rules between blanks use look-around so that neighbours may share a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.masking import WILDCARD
from lineloom.functions.regex import strip_blanks

# Where tokens end.
TOKEN_DELIMITERS = ",!;:=|\"'[](){}.-+@#$%&"
_D = "\\s" + "".join("\\" + ch for ch in TOKEN_DELIMITERS)
_V = r"<\*>"


def trim_blanks(col: Column) -> Column:
    """E1a."""
    return F.regexp_replace(strip_blanks(col), r"(?U)\s+", " ")


def digit_tokens(col: Column) -> Column:
    """E1b."""
    return F.regexp_replace(col, f"(?U)(?<![^{_D}])\\d+(?![^{_D}])", WILDCARD)


def words_with_variable(col: Column) -> Column:
    """E1c."""
    return F.regexp_replace(col, f"(?U)(?<![^{_D}])[^{_D}/]*{_V}[^{_D}/]*(?![^{_D}])", WILDCARD)


def _runs(col: Column, joint: str) -> Column:
    return F.regexp_replace(col, f"{_V}(?:{joint}{_V})+", WILDCARD)


def dotted_and_consecutive(col: Column) -> Column:
    """E1d."""
    return _runs(_runs(col, r"\."), "")


def hash_wrapped(col: Column) -> Column:
    """E1e."""
    both = F.regexp_replace(col, f"(?<= )#{_V}#(?= )", WILDCARD)
    return F.regexp_replace(both, f"(?<= )#{_V}(?= )", WILDCARD)


def joined_variables(col: Column) -> Column:
    """E1f."""
    for joint in (":", "#", "/", "@", r"\."):
        col = _runs(col, joint)
    return col


def quoted_variables(col: Column) -> Column:
    """E1g."""
    for quote in ('"', "'"):
        col = F.regexp_replace(col, f"(?<= ){quote}{_V}{quote}(?= )", WILDCARD)
    return _runs(col, "")


def correct_template(col: Column) -> Column:
    """All rules in order."""
    for rule in (
        trim_blanks, digit_tokens, words_with_variable, dotted_and_consecutive, hash_wrapped, joined_variables,
        quoted_variables,
    ):
        col = rule(col)
    return col


def correct_templates(df: DataFrame, column: str = "EventTemplate") -> DataFrame:
    """E2."""
    return df.withColumn(column, correct_template(F.col(column)))
