"""Header formats such as ``<Date> <Time> <Level>: <Content>``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.functions.masking import SEP
from lineloom.functions.regex import java_regex, strip_blanks

NON_ASCII_MARK = "<N/ASCII>"


class FormatError(RuntimeError):
    """No format was given, or no line matched it."""


@dataclass(frozen=True)
class LogFormat:
    """A compiled format: one Java pattern with a positional group per header."""

    pattern: str
    headers: tuple[str, ...]
    groups: tuple[int, ...]  # group number of each header
    guards: tuple[int, ...]  # number of the optional group around it, 0 where there is none


@dataclass
class _Group:
    """A bracketed part of a format: how it opens, its alternatives, and how often it may occur."""

    opener: str
    branches: list[list]
    times: str

    @property
    def uncertain(self) -> bool:
        """May the match leave one of its branches out?"""
        return len(self.branches) > 1 or self.times[:1] in ("?", "*") or self.times.startswith("{0")


@dataclass
class _Slot:
    name: str


_OPENER = re.compile(r"\((?:\?(?:<[=!]|<\w+>|[a-z-]*:|[=!>]))?")
_PIECES = re.compile(r"(?P<slot><[^<>]+>)|(?P<escape>\\.)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<blanks> +)|(?P<other>.)", re.S)
_TIMES = re.compile(r"(?:[?*+]|\{\d*,?\d*\})?[?+]?")


def _alternatives(text: str, at: int) -> tuple[list[list], int]:
    """The branches from ``at`` to the closing bracket or the end, as lists of regex text, slots and groups."""
    branches: list[list] = [[]]
    while at < len(text) and text[at] != ")":
        if text[at] == "|":
            branches.append([])
            at += 1
        elif text[at] == "(" and not re.match(r"\(\?[a-z-]+\)", text[at:]):
            opener = _OPENER.match(text, at)
            inner, end = _alternatives(text, opener.end())
            times = _TIMES.match(text, end + 1)
            branches[-1].append(_Group(opener.group(), inner, times.group()))
            at = times.end()
        else:
            piece = _PIECES.match(text, at)
            kind, part = piece.lastgroup, piece.group()
            branches[-1].append(_Slot(part[1:-1]) if kind == "slot" else r"\s+" if kind == "blanks" else part)
            at = piece.end()
    return branches, at


def _walk(part):
    """All slots and texts at or below ``part``."""
    if isinstance(part, _Group):
        for branch in part.branches:
            for inner in branch:
                yield from _walk(inner)
    else:
        yield part


class _Writer:
    """Writes the Java pattern; a branch that may be missing gets a group whose text tells whether it took part."""

    def __init__(self):
        self.count = 0
        self.slots: list[tuple[str, int, int]] = []  # name, group, guard

    def sequence(self, parts: list, guard: int) -> str:
        return "".join(self.part(p, guard) for p in parts)

    def part(self, part, guard: int) -> str:
        if isinstance(part, str):
            return part
        if isinstance(part, _Slot):
            self.count += 1
            self.slots.append((part.name, self.count, guard))
            return "(.*?)"
        captures = part.opener == "(" or re.fullmatch(r"\(\?<\w+>", part.opener)
        self.count += bool(captures)
        own = self.count
        written = []
        for branch in part.branches:
            below = [x for p in branch for x in _walk(p)]
            # with nothing but slots inside, an empty text does not tell
            telling = part.uncertain and any(isinstance(x, _Slot) for x in below) and any(isinstance(x, str) for x in below)
            if telling and captures and len(part.branches) == 1:
                written.append(self.sequence(branch, own))
            elif telling:
                self.count += 1
                written.append(f"({self.sequence(branch, self.count)})")
            else:
                written.append(self.sequence(branch, guard))
        return f"{part.opener}{'|'.join(written)}){part.times}"


def compile_log_format(log_format: str) -> LogFormat:
    """A3: literal parts are the user's own regex, runs of blanks match any white space, slots are lazy."""
    if not log_format:
        raise FormatError("a log format is required")
    branches, end = _alternatives(log_format, 0)
    if end < len(log_format):
        raise FormatError(f"a bracket is closed that was not opened in {log_format!r}")
    writer = _Writer()
    body = "|".join(writer.sequence(b, 0) for b in branches)
    names = tuple(name for name, _, _ in writer.slots)
    if len(set(names)) != len(names):
        raise FormatError(f"a header occurs twice in {log_format!r}")
    return LogFormat(
        java_regex(f"^{body}$"), names, tuple(g for _, g, _ in writer.slots), tuple(g for _, _, g in writer.slots)
    )


def _needed_groups(fmt: LogFormat) -> list[int]:
    return sorted({g for g in fmt.groups + fmt.guards if g})


def header_groups(line: Column, fmt: LogFormat) -> Column:
    """The groups that the headers need, of a matching line, as one array.

    One pass of the pattern rewrites the line to its groups; a line that holds the separator itself takes one
    extraction per group instead.
    """
    needed = _needed_groups(fmt)
    one_pass = F.split(F.regexp_replace(line, fmt.pattern, SEP.join(f"${g}" for g in needed)), SEP)
    by_group = F.array(*[F.regexp_extract(line, fmt.pattern, g) for g in needed])
    return F.when(F.contains(line, F.lit(SEP)), by_group).otherwise(one_pass)


def header_columns(groups: Column, fmt: LogFormat) -> list[Column]:
    """One column per header from the array of ``header_groups``, NULL where an optional part is missing."""
    slot = {g: i for i, g in enumerate(_needed_groups(fmt))}
    columns = []
    for header, group, guard in zip(fmt.headers, fmt.groups, fmt.guards):
        value = F.get(groups, F.lit(slot[group]))
        if guard:
            value = F.when(F.get(groups, F.lit(slot[guard])) != "", value)
        columns.append(value.alias(header))
    return columns


def parse_log_lines(
    lines: DataFrame, log_format: str | LogFormat, column: str = "value", keep: tuple[str, ...] = ("LineId",)
) -> DataFrame:
    """A4: strip, keep the lines that match, and extract one string column per header."""
    fmt = log_format if isinstance(log_format, LogFormat) else compile_log_format(log_format)
    kept = [F.col(c) for c in keep if c in lines.columns]
    matching = (
        lines.select(*kept, strip_blanks(F.col(column)).alias("__line"))
        .where(F.col("__line").rlike(fmt.pattern))
        .select(*kept, header_groups(F.col("__line"), fmt).alias("__groups"))
    )
    return matching.select(*kept, *header_columns(F.col("__groups"), fmt))


def require_loaded(df: DataFrame, log_format: str | None = "given") -> DataFrame:
    """Fail early on a missing format or when nothing was loaded."""
    if not log_format:
        raise FormatError("a log format is required")
    if df.isEmpty():
        raise FormatError("no line matches the log format, or the file is empty")
    return df


def load_report(lines: DataFrame, log_format: str | LogFormat, column: str = "value") -> DataFrame:
    """Lines read, loaded and skipped, and the loading rate, in one pass."""
    fmt = log_format if isinstance(log_format, LogFormat) else compile_log_format(log_format)
    hit = strip_blanks(F.col(column)).rlike(fmt.pattern)
    counts = lines.select(hit.alias("hit")).agg(
        F.count(F.lit(1)).alias("LinesRead"), F.count_if("hit").alias("LinesLoaded")
    )
    return counts.select(
        "LinesRead",
        "LinesLoaded",
        (F.col("LinesRead") - F.col("LinesLoaded")).alias("LinesSkipped"),
        F.try_divide(F.col("LinesLoaded").cast("double"), F.col("LinesRead").cast("double")).alias("LoadingRate"),
    )


def observe_load(lines: DataFrame, log_format: str | LogFormat, observation, column: str = "value") -> DataFrame:
    """A6 without a second pass: attach the counts to whatever job reads the lines (batch or stream)."""
    fmt = log_format if isinstance(log_format, LogFormat) else compile_log_format(log_format)
    hit = strip_blanks(F.col(column)).rlike(fmt.pattern)
    return lines.observe(
        observation,
        F.count(F.lit(1)).alias("LinesRead"),
        F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("LinesLoaded"),
    )
