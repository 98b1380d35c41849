"""Small scalar functions over template and message text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lineloom.functions.masking import SEP, WILDCARD
from lineloom.functions.regex import strip_blanks

# Characters that separate message tokens, and those of them that survive inside a token.
MESSAGE_PUNCTUATION = "!\"#$%&'()+,-/:;=?@.[\\]^_`{|}~"
KEPT_PUNCTUATION = "=|()"


def _char_class(chars: str) -> str:
    return "".join("\\" + ch for ch in chars)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` reads it, inside functions over arrays too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def message_tokens(col: Column) -> Column:
    """Words and the kept punctuation of a message; neighbouring wildcards become one."""
    runs = f"(?U)([\\s{_char_class(MESSAGE_PUNCTUATION)}]+)"
    dropped = "".join(ch for ch in MESSAGE_PUNCTUATION if ch not in KEPT_PUNCTUATION) + " "
    pieces = F.split(F.regexp_replace(F.replace(col, F.lit(SEP), F.lit("")), runs, f"{SEP}$1{SEP}"), SEP)
    cleaned = F.transform(
        pieces,
        lambda t: F.when(F.contains(t, F.lit(WILDCARD)), WILDCARD).otherwise(F.translate(t, dropped, "")),
    )
    # a run of other blanks (tabs, line ends) stays as an empty token
    words = F.transform(F.filter(cleaned, lambda t: t != ""), strip_blanks)


    def collapsed(words: Column) -> Column:
        return F.filter(
            words,
            lambda t, i: ~((t == WILDCARD) & (F.coalesce(F.get(words, i - 1), F.lit("")) == WILDCARD)),
        )

    return once(words, collapsed)


def template_similarity(a: Column, b: Column) -> Column:
    """Shared distinct tokens over both lengths less the shared ones.  NULL when both are empty."""

    def ratio(x: Column, y: Column) -> Column:
        sizes = F.size(x) + F.size(y)
        return once(F.size(F.array_intersect(x, y)), lambda shared: F.try_divide(shared.cast("double"), (sizes - shared).cast("double")))

    return once(F.struct(message_tokens(a).alias("x"), message_tokens(b).alias("y")), lambda pair: ratio(pair["x"], pair["y"]))


def event_id(col: Column) -> Column:
    """The first eight hex digits of the MD5 of the text."""
    return F.substring(F.md5(col), 1, 8)


def render_template(tokens: Column, joint: str = "") -> Column:
    """The tokens carry their delimiters, so plain concatenation restores the text."""
    return F.array_join(tokens, joint)


def lenient_template_equal(truth: Column, parsed: Column) -> Column:
    """Equal blank-separated tokens once every truth token with a wildcard is a wildcard."""
    loosened = F.regexp_replace(truth, r"(?<![^ ])[^ ]*<\*>[^ ]*", WILDCARD)
    return loosened.eqNullSafe(parsed)


def convert_date(col: Column) -> Column:
    """``yyyy-MM-dd`` to ``dd/MM/yyyy``."""
    return F.date_format(F.to_date(col, "yyyy-MM-dd"), "dd/MM/yyyy")
