"""Helpers for user-given regular expressions that are written in Python's dialect and run by the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode classes, and "." stops only at "\n": what a Python pattern means.
FLAGS = "(?Ud)"

# Fixed value: the characters that str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def java_regex(pattern: str) -> str:
    return FLAGS + pattern.replace("(?P<", "(?<")


def group_spans(pattern: str) -> list[tuple[int, int]]:
    """(start, end) of every capturing group, in numbering order."""
    spans: list[tuple[int, int]] = []
    opened: list[int] = []  # index into spans, or -1 for a group that does not capture
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            # a "]" in first place is a literal
            i += 1 + pattern.startswith("^", i + 1)
            i -= not pattern.startswith("]", i)
        elif ch == "(":
            rest = pattern[i + 1:i + 4]
            named = rest.startswith("?P<") or (rest.startswith("?<") and rest[2:3] not in ("=", "!"))
            if rest.startswith("?") and not named:
                opened.append(-1)
            else:
                opened.append(len(spans))
                spans.append((i, -1))
        elif ch == ")" and opened:
            slot = opened.pop()
            if slot >= 0:
                spans[slot] = (spans[slot][0], i)
        i += 1
    return spans


def count_groups(pattern: str) -> int:
    return len(group_spans(pattern))
