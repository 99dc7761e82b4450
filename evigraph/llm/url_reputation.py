"""URL filter: explicit rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes are shrunk from host to registered domain to suffix: each level's
rate is a beta-binomial posterior whose prior mean is the posterior mean of the level above
without the group's own pages (they would count twice), and whose strength is estimated from how far the rates of that level differ (moments).
A page is blocked when the lower posterior bound of its host's bad rate is above a limit.
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import ascii_lower
from evigraph.session import persist_table

# Labels that form a suffix of two labels in front of a country code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """``deviations`` posterior standard deviations below the mean is the bound that must not exceed ``limit``."""

    limit: float = 0.5
    deviations: float = 1.645
    least_rho: float = 0.001
    most_rho: float = 0.5


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract("url", URL_PARTS, n), F.lit(""))
    return pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})


def rule_text(rules: list[Rule]) -> Column:
    """The longest rule that fits (host or a parent domain, path prefix); of equal texts the block rule."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fits = [
        F.when(((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path)), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds site (host without user and port), domain and suffix. Addresses and single labels are their own domain."""
    site = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    last = lambda n: F.substring_index("site", ".", -n)
    dots = F.length("site") - F.length(F.replace("site", F.lit(".")))
    two = F.col("site").rlike(rf"\.({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    address = F.col("site").rlike(r"^[0-9.]*$|^\[")
    suffix = F.when(address | (dots == 0), F.col("site")).when(two, last(2)).otherwise(last(1))
    domain = F.when(address | (dots == 0), F.col("site")).when(two, last(3)).otherwise(last(2))
    return hosts.withColumn("site", site).withColumns({"suffix": suffix, "domain": domain})


def _strength(groups: DataFrame, settings: Reputation) -> float:
    """Prior strength of a level from the spread of its groups (n, bad) around their parents' means (mu)."""
    spread = (F.col("bad") - F.col("n") * F.col("mu")) ** 2 / (F.col("n") * F.col("mu") * (1 - F.col("mu")))
    row = groups.filter("n > 0").agg(F.sum(spread).alias("z"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") - 1).alias("more")).first()
    if not row["more"]:
        return 1 / settings.most_rho - 1
    rho = min(max((row["z"] - row["k"]) / row["more"], settings.least_rho), settings.most_rho)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """(host, n, bad, mean, lower) for every host of ``outcomes`` (host, bad); bad is null for pages without a label.

    Without any label the overall rate is one half. Rows are combined before any shuffle, so a hot host is one row per task.
    """
    label = F.col("bad").cast("long")
    counts = outcomes.groupBy("host").agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"))
    hosts = persist_table(with_levels(counts), "hosts")
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((everything["bad"] or 0) + 1) / ((everything["n"] or 0) + 2)

    level = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strength = _strength(level("suffix").withColumn("mu", F.lit(mean)), settings)
    suffixes = level("suffix").withColumn("mu", F.lit(mean))
    domains = persist_table(level("domain", "suffix").alias("g").join(suffixes.alias("up"), "suffix").select("domain", "suffix", *_below(strength)), "domains")
    strength = _strength(domains, settings)
    leaves = hosts.alias("g").join(domains.alias("up"), ["domain", "suffix"]).select("host", *_below(strength))
    leaves = persist_table(leaves, "leaves")
    strength = _strength(leaves, settings)
    a = F.col("bad") + strength * F.col("mu")
    b = F.col("n") - F.col("bad") + strength * (1 - F.col("mu"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return leaves.select("host", "n", "bad", (a / (a + b)).alias("mean"), (a / (a + b) - settings.deviations * deviation).alias("lower"))


def _below(strength: float) -> list[Column]:
    """Counts of a group and its prior mean: the posterior mean of the parent without the group's own pages."""
    others, bad = F.col("up.n") - F.col("g.n"), F.col("up.bad") - F.col("g.bad")
    return [F.col("g.n"), F.col("g.bad"), ((bad + strength * F.col("up.mu")) / (others + strength)).alias("mu")]


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], settings: Reputation = Reputation()) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower) for every row of ``pages`` (page_id, url).

    ``labels`` (page_id, bad) may repeat a page (one bad label counts) and may be empty. Repeated rows of ``pages`` are
    judged alike and each count as an outcome; a null page_id has no label. Clashing extra columns are not read.
    """
    parted = with_parts(pages.select("page_id", "url"))
    label = labels.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = host_reputation(parted.select("page_id", "host").join(label, "page_id", "left"), settings)
    known = persist_table(hosts.select("host", F.col("mean").alias("bad_rate"), "lower"), "reputation")
    method = F.when(F.col("lower") > settings.limit, F.lit("block")).otherwise(F.lit("allow"))
    return (
        parted.withColumn("_rule", rule_text(rules))
        .join(known, "host", "left")
        .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), "bad_rate", "lower")
    )
