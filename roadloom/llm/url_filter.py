"""URL filter: fixed rules first, else the reputation of the host by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import ascii_lower, landed

#: second-level names under which a country sells registered domains (fixed values)
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: rules of the registered query (fixed values)
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (
        pages.withColumn("_rest", rest)
        .withColumn("_host", F.regexp_extract("_rest", r"^([^/?#]*)", 1))
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^([^?#]*)", 1))
        .withColumn("host", ascii_lower("_host"))
        .drop("_rest", "_host")
    )


def _levels(df: DataFrame) -> DataFrame:
    """Adds ``domain`` (registered) and ``suffix`` of ``host``."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    two = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(n >= 2, F.lit(-2)).otherwise(F.lit(-1))).isin(*SECOND_LEVEL)
    return (
        df.withColumn("_parts", parts)
        .withColumn("_keep", F.when(two, 3).otherwise(2))
        .withColumn("domain", F.expr("array_join(slice(_parts, greatest(size(_parts) - _keep + 1, 1), _keep), '.')"))
        .withColumn("suffix", F.expr("array_join(slice(_parts, greatest(size(_parts) - _keep + 2, 1), _keep - 1), '.')"))
        .drop("_parts", "_keep")
    )


def _strength(stats: DataFrame, floor: float = 1e-3) -> tuple[float, float]:
    """Mean and prior strength (pseudo-counts) of a level, by the moments of the beta-binomial.

    One aggregate row reaches the driver. A level without spread gets the largest strength.
    """
    row = stats.filter("n > 0").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("g"),
        F.sum(F.expr("double(k) * k / n")).alias("kk"), F.sum(F.expr("double(n) * n")).alias("nn"),
    ).first()
    if not row.n:
        return 0.5, 1.0 / floor - 1.0
    mean = (row.k + 0.5) / (row.n + 1.0)
    spread = row.kk - row.k * row.k / row.n
    free = mean * (1 - mean)
    below = free * (row.n - row.nn / row.n - (row.g - 1))
    rho = (spread - free * (row.g - 1)) / below if below > 0 else floor
    rho = min(max(rho, floor), 1 - floor)
    return mean, 1.0 / rho - 1.0


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of the share of bad pages per host.

    ``outcomes``: ``host``, ``bad`` (boolean). The overall mean is the prior of a suffix, the
    suffix that of a registered domain, the domain that of a host; each level's strength
    comes from its own spread. Returns host, n, k, mean, lower (mean less z deviations).
    Hosts are pre-aggregated before anything is joined, so a hot host is one row.
    """
    stats = landed(
        _levels(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))),
        "host-outcomes",
    )
    domains = stats.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = stats.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mean, of_suffix = _strength(suffixes)
    of_domain, of_host = _strength(domains)[1], _strength(stats)[1]
    suffixes = suffixes.select("suffix", ((F.col("k") + of_suffix * mean) / (F.col("n") + of_suffix)).alias("ms"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", "suffix", ((F.col("k") + of_domain * F.col("ms")) / (F.col("n") + of_domain)).alias("md")
    )
    a, b = F.col("k") + of_host * F.col("md"), F.col("n") - F.col("k") + of_host * (1 - F.col("md"))
    return (
        stats.join(domains, ["suffix", "domain"])
        .withColumn("_a", a).withColumn("_b", b)
        .withColumn("mean", F.expr("_a / (_a + _b)"))
        .withColumn("lower", F.expr(f"mean - {z}D * sqrt(mean * (1 - mean) / (_a + _b + 1))"))
        .select("host", "n", "k", "mean", "lower")
    )


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, limit: float = 0.5, z: float = 1.645
) -> DataFrame:
    """Allows or blocks every page by its url.

    ``pages``: page_id, url. ``labels``: doc_id (the page it judges), quality, toxic; a page is
    bad if its quality is 0 or it is toxic; labels with both values null are no outcome, and
    repeated labels of a page count once (bad if any is). The longest rule that fits decides;
    without one a page is blocked if the lower bound of its host's bad share exceeds ``limit``.
    A host without outcomes is allowed. Null urls have an empty host, a host like any other.
    Other columns are not read; repeated rows are judged alike; empty tables give no rows.
    """
    parsed = split_url(pages.select("page_id", "url"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    outcome = (
        labels.filter("quality is not null or toxic is not null")
        .groupBy("doc_id").agg(F.max(bad).alias("bad")).withColumnRenamed("doc_id", "page_id")
    )
    reputation = landed(host_reputation(parsed.join(outcome, "page_id").select("host", "bad"), z), "host-reputation")
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = [
        ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        for r in ordered
    ]

    def first(values):
        return F.coalesce(*[F.when(c, F.lit(v)) for c, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))

    return (
        parsed.join(reputation, "host", "left")
        .withColumn("rule", first([r.text for r in ordered]))
        .withColumn("_ruled", first([r.verdict for r in ordered]))
        .withColumn("verdict", F.coalesce("_ruled", F.when(F.col("lower") > limit, "block").otherwise("allow")))
        .select(
            "page_id", "host", "path", "rule", "verdict",
            F.coalesce("n", F.lit(0)).alias("n_outcomes"), F.round("lower", 6).alias("bad_at_least"),
        )
    )
