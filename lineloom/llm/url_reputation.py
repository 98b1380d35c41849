"""URL verdicts: listed rules first, then the reputation of the host.

Reputation is empirical Bayes.  Labelled pages are counted by host.  A host's good rate is shrunk towards its registered
domain, the domain towards its suffix, the suffix towards all pages: at each level the parent's rate and the level's
strength are a beta prior, and the strength comes from the counts themselves, by the moments of the
beta-binomial (children that differ little are pulled hard).  A host is blocked if even the upper posterior bound of its
good rate lies below ``min_good``.

Counts are summed before any shuffle; pages meet their host's verdict in a join, in which Spark splits a host that holds
many pages.  No table is collected but three strengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lineloom.llm.rows import ascii_lower

#: Action, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Second-level names below a country's domain that take registrations themselves
SHARED_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
MIN_GOOD = 0.5
DEVIATIONS = 1.0
LEAST_RHO, MOST_RHO = 0.001, 0.5


def url_parts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path``; both empty for a url that is null or has no ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    parts = pages.select("page_id", rest.alias("rest")).select(
        "page_id", "rest", F.regexp_extract("rest", "^[^/?#]*", 0).alias("named")
    )
    path = F.regexp_extract(F.expr("substring(rest, length(named) + 1)"), r"^[^?#]*", 0)
    missing = F.col("rest").isNull()
    return parts.select(
        "page_id", F.when(missing, "").otherwise(ascii_lower(F.col("named"))).alias("host"),
        F.when(missing, "").otherwise(path).alias("path"),
    )


def _choose(rules: Sequence[tuple[str, str, str]], value) -> Column:
    """The longest rule that fits; of two that are equally long the one listed first."""
    chosen = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        chosen = F.when(fits, value(rule)) if chosen is None else chosen.when(fits, value(rule))
    return F.lit(None).cast("string") if chosen is None else chosen


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``suffix``; a host without a dot is all three."""
    labels = F.split("host", r"\.")
    count = F.size(labels)
    shared = (count > 2) & (F.length(F.get(labels, count - 1)) == 2) & F.get(labels, count - 2).isin(*SHARED_LABELS)
    width = F.when(shared, 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), count - n + 1), n), ".")
    return hosts.withColumn("suffix", tail(width)).withColumn("domain", tail(width + 1))


def _strength(children: DataFrame, parent: str | None) -> float:
    """Prior strength of one level: ``(1 - rho) / rho``, ``rho`` the share of variance that lies between the children."""
    by_parent = (children.groupBy(parent) if parent else children.groupBy(F.lit("all").alias("parent"))).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("children"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("sizes"),
    ).where("children > 1")
    rate = F.col("k") / F.col("n")
    row = by_parent.where((rate > 0) & (rate < 1)).agg(
        F.sum((F.col("squares") - F.col("k") * rate) / (rate * (1 - rate)) - (F.col("children") - 1)).alias("excess"),
        F.sum(F.col("n") - F.col("sizes") / F.col("n") - (F.col("children") - 1)).alias("room"),
    ).first()
    rho = row["excess"] / row["room"] if row["room"] and row["room"] > 0 else LEAST_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return (1 - rho) / rho


def host_reputation(
    parts: DataFrame, outcomes: DataFrame, min_good: float = MIN_GOOD, deviations: float = DEVIATIONS
) -> DataFrame:
    """``host, n, k, good_rate, upper, blocked`` for every host of ``parts``.

    ``outcomes(page_id, good)``: missing ids or outcomes are skipped, several for one page count each.
    """
    labelled = outcomes.where(F.col("page_id").isNotNull() & F.col("good").isNotNull()).select(
        F.col("page_id").alias("its_page"), F.col("good").cast("bigint").alias("good")
    )
    counts = parts.join(labelled, F.col("page_id") == F.col("its_page"), "left").groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")
    )
    counts = with_levels(counts)
    seen = counts.where("n > 0")
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = (whole["k"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    strong = [_strength(suffixes, None), _strength(domains, "suffix"), _strength(seen, "domain")]

    def shrunk(k: str, n: str, rate: Column, strength: float) -> Column:
        return (F.col(k) + strength * rate) / (F.col(n) + strength)

    suffixes = suffixes.select("suffix", shrunk("k", "n", F.lit(base), strong[0]).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", shrunk("k", "n", F.col("suffix_rate"), strong[1]).alias("domain_rate")
    )
    rated = counts.join(suffixes, "suffix", "left").join(domains, "domain", "left")
    prior = F.coalesce("domain_rate", "suffix_rate", F.lit(base))
    rated = rated.withColumn("good_rate", shrunk("k", "n", prior, strong[2]))
    spread = F.sqrt(F.col("good_rate") * (1 - F.col("good_rate")) / (F.col("n") + strong[2] + 1))
    upper = F.col("good_rate") + deviations * spread
    return rated.select("host", "n", "k", "good_rate", upper.alias("upper"), (upper < min_good).alias("blocked"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **options
) -> DataFrame:
    """``page_id, host, path, rule, verdict, upper`` for every row of ``pages``.

    A url without a host belongs to the host ``''``, which has a reputation like any other.  Repeated rows are judged alike.
    """
    parts = url_parts(pages)
    reputation = host_reputation(parts, outcomes, **options).select(
        F.col("host").alias("its_host"), "upper", "blocked"
    )
    judged = parts.withColumn("rule", _choose(rules, lambda r: F.lit(r[1] + r[2]))).withColumn(
        "listed", _choose(rules, lambda r: F.lit(r[0]))
    ).join(reputation, F.col("host") == F.col("its_host"))
    verdict = F.coalesce("listed", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "upper")
