"""Masking of variable parts in message text.

A message travels as one *marked* string: its tokens separated by U+0001.  Every mask is then a ``regexp_replace``
over that string, which stays inside generated code and lets mining group on a plain string; the functions over
``array<string>`` are thin wrappers around the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.regex import count_groups, java_regex

SEP = "\u0001"
WILDCARD = "<*>"

_AT_TOKEN = f"(?<![^{SEP}])"
_REST = f"[^{SEP}]*+"
_LEADING_DIGIT = r"\d"
_SPECIAL = "/:@#_"
# a second special character that differs from the first, or a third one
_SPECIAL_CHARS = (
    f"[^{SEP}{_SPECIAL}]*+([{_SPECIAL}])[^{SEP}{_SPECIAL}]*+"
    f"(?:(?!\\1)[{_SPECIAL}]|[{_SPECIAL}][^{SEP}{_SPECIAL}]*+[{_SPECIAL}])"
)
_PATH_DASH = f"[^{SEP}/-]*+[/-]"

# Words that are not the name of a user when they follow "user": fixed values.
KEEP_WORDS = (
    "is", "was", "are", "were", "be", "been", "has", "have", "had", "does", "did", "do", "logged", "logs", "login",
    "added", "deleted", "removed", "created", "changed", "requested", "disconnected", "connected", "authenticated",
    "failed", "denied", "closed", "opened", "started", "stopped", "entered", "left", "not", "already", "now", "never",
    "in", "on", "at", "by", "of", "for", "from", "with", "via", "as", "after", "before", "because", "if", "since",
    "through", "under", "without", "than", "until", "while",
)
_KEEP_SYMBOL = r"^[.,:;()\[\]{}!?]"


def mark_tokens(col: Column, splitters: str = r"(\s+)") -> Column:
    """B2 in marked form: split at ``splitters``; a captured delimiter becomes a token, empty tokens vanish."""
    groups = count_groups(splitters)
    if groups > 1:
        raise ValueError("splitters may hold at most one capturing group")
    glue = f"{SEP}$1{SEP}" if groups else SEP
    text = F.regexp_replace(F.replace(col, F.lit(SEP), F.lit("")), java_regex(splitters), glue)
    return F.btrim(F.regexp_replace(text, f"{SEP}{{2,}}", SEP), F.lit(SEP))


def marked_to_tokens(marked: Column) -> Column:
    return F.when(marked == "", F.array().cast("array<string>")).otherwise(F.split(marked, SEP))


def marked_length(marked: Column) -> Column:
    seps = F.length(marked) - F.length(F.replace(marked, F.lit(SEP), F.lit("")))
    return F.when(marked == "", F.lit(0)).otherwise(seps + 1)


def _on_tokens(mask: Callable[[Column], Column], tokens: Column) -> Column:
    return marked_to_tokens(mask(F.array_join(tokens, SEP)))


def mask_patterns(col: Column, patterns: Sequence[str]) -> Column:
    """B1: replace each pattern, in the given order."""
    for pattern in patterns:
        col = F.regexp_replace(col, java_regex(pattern), WILDCARD)
    return col


def tokenize(col: Column, splitters: str = r"(\s+)") -> Column:
    """B2: tokens with their captured delimiters."""
    return marked_to_tokens(mark_tokens(col, splitters))


def _assignment(marked: Column) -> Column:
    return F.regexp_replace(marked, java_regex(f"{_AT_TOKEN}={SEP}\\w{_REST}"), f"={SEP}{WILDCARD}")


def mask_assignment(tokens: Column) -> Column:
    """The value after a lone ``=``."""
    return _on_tokens(_assignment, tokens)


def mask_user(tokens: Column, keep_words: Sequence[str] = KEEP_WORDS) -> Column:
    """The token two after ``user``, unless it is a keep word or a symbol.

    A token that was masked cannot trigger again, so only where two ``user`` tokens stand two apart do the earlier
    decisions matter; those messages take the fold, all others a plain look-back.
    """
    keep = list(keep_words)

    def is_user(x: Column) -> Column:
        return F.lower(x) == "user"

    def may_mask(x: Column) -> Column:
        kept = F.lower(x).isin(keep) if keep else F.lit(False)
        return ~(kept | x.rlike(_KEEP_SYMBOL))

    def back(ts: Column, i: Column) -> Column:
        return F.coalesce(F.get(ts, i - 2), F.lit(""))

    look_back = F.transform(
        tokens, lambda x, i: F.when(is_user(back(tokens, i)) & may_mask(x), WILDCARD).otherwise(x)
    )
    fold = F.aggregate(
        tokens,
        F.array().cast("array<string>"),
        lambda acc, x: F.concat(
            acc,
            F.array(F.when(is_user(back(acc, F.size(acc))) & may_mask(x), WILDCARD).otherwise(x)),
        ),
    )
    chained = F.exists(
        F.transform(tokens, lambda x, i: is_user(x) & is_user(back(tokens, i))), lambda hit: hit
    )
    return (
        F.when(~F.exists(tokens, is_user), tokens)
        .when(chained, fold)
        .otherwise(look_back)
    )


def _token_rules(marked: Column, *rules: str) -> Column:
    return F.regexp_replace(marked, java_regex(f"{_AT_TOKEN}(?:{'|'.join(rules)}){_REST}"), WILDCARD)


def mask_leading_digit(tokens: Column) -> Column:
    """A token that starts with a digit."""
    return _on_tokens(lambda m: _token_rules(m, _LEADING_DIGIT), tokens)


def mask_special_chars(tokens: Column) -> Column:
    """A token with two different, or three, of ``/ : @ # _``."""
    return _on_tokens(lambda m: _token_rules(m, _SPECIAL_CHARS), tokens)


def mask_path_dash(tokens: Column) -> Column:
    """A token that holds ``/`` or ``-``."""
    return _on_tokens(lambda m: _token_rules(m, _PATH_DASH), tokens)


def _where_found(df: DataFrame, column: str, needles: Sequence[str], changed: Column) -> DataFrame:
    """Put ``changed`` only where one of the plain strings occurs: a byte search is far cheaper than a pattern."""
    found = reduce(Column.__or__, [F.contains(F.col(column), F.lit(needle)) for needle in needles])
    return df.withColumn(column, F.when(found, changed).otherwise(F.col(column)))


def with_signature(
    df: DataFrame,
    content: str = "Content",
    patterns: Sequence[str] = (),
    splitters: str = r"(\s+)",
    leading_digit: bool = False,
    keep_words: Sequence[str] = KEEP_WORDS,
    column: str = "Signature",
) -> DataFrame:
    """All masks in order, as a marked string.  The per-token rules share one pass of one pattern.

    Each step is a projection of its own: a step refers to its input more than once, and in one expression that would
    evaluate the earlier steps again.
    """
    marked = F.col(column)
    df = df.withColumn(column, mark_tokens(mask_patterns(F.col(content), patterns), splitters))
    df = _where_found(df, column, ("=" + SEP,), _assignment(marked))
    # the words become a column first: the look-back reads them once per token
    user_token = f"(?i){_AT_TOKEN}user(?![^{SEP}])"
    touched = F.contains(F.lower(marked), F.lit("user")) & marked.rlike(user_token)
    words = F.col("__words")
    df = df.withColumn("__words", F.when(touched, F.split(marked, SEP)))
    masked_user = F.array_join(mask_user(words, keep_words), SEP)
    df = df.withColumn(column, F.when(words.isNotNull(), masked_user).otherwise(marked)).drop("__words")
    rules = [_PATH_DASH, _SPECIAL_CHARS]
    if leading_digit:
        df = df.withColumn(column, _token_rules(marked, _LEADING_DIGIT, *rules))
    else:
        df = _where_found(df, column, tuple(_SPECIAL + "-"), _token_rules(marked, *rules))
    # never NULL: a join on it then infers no filter that would repeat all of the above
    return df.withColumn(column, F.coalesce(marked, F.lit("")))
