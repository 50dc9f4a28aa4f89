"""URL filters by the reputation of hosts: empirical Bayes with beta-binomial priors from suffix over registered domain to host.

Labelled pages are counted per host. A host's rate of bad pages is shrunk towards that of its registered domain, this towards that of its
suffix, and this towards the overall rate. How strongly is read from the data: the more the rates of one level spread around their
parents, the weaker the prior. A host is blocked when the lower bound of its posterior reaches the threshold. Allow and block rules
stand above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

# The given rules (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Suffixes besides the last label that are known without a table. A run on real hosts passes the public list.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
MAX_LABELS = 5
WEAKEST, STRONGEST = 1.0, 1000.0
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Text behind the first :// up to / ? # or the end, A-Z lower-cased; empty for null and for no ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def with_suffix(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` (one row each) with ``suffix``, the longest of the table ``suffixes(suffix)`` in which the host ends, else its last label, and ``domain``: one label
    more. A host without more labels is its own domain. Suffixes of up to ``MAX_LABELS`` labels are looked up, by equality."""
    labels = F.split("host", "[.]", -1)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(MAX_LABELS))), lambda n: F.struct(n.alias("n"), tail(n).alias("suffix")))
    found = (hosts.select("host", F.explode(tails).alias("x")).select("host", "x.*").join(suffixes.select("suffix").distinct(), "suffix")
             .groupBy(F.col("host").alias("_host")).agg(F.max("n").alias("_n")))
    n = F.coalesce("_n", F.lit(1))
    return hosts.join(found, F.col("host") == F.col("_host"), "left").withColumns({"suffix": tail(n), "domain": tail(n + 1)}).drop("_host", "_n")


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), else null. Equally long rules: the earlier one.

    A rule fits its host and all subdomains if the path starts with the rule's. The list is a setting, so it becomes one expression.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        at = rule.index("/") if "/" in rule else len(rule)
        fits = (host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))
        found = F.when(fits & F.startswith(path, F.lit(rule[at:])), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def strength(n: int, k: int, groups: int, n_square: float, spread: float) -> float:
    """Prior observations: from how far the rates of ``groups`` spread (sum of k*k/n) beyond what chance explains."""
    if groups < 2 or k in (0, n) or n * n <= n_square:
        return STRONGEST
    rate = k / n
    excess = (spread - k * k / n) / (rate * (1 - rate)) - (groups - 1)
    correlation = excess / (n - n_square / n - (groups - 1)) if n - n_square / n > groups - 1 else 0.0
    return STRONGEST if correlation <= 0 else min(STRONGEST, max(WEAKEST, 1 / correlation - 1))


def level_strength(counts: DataFrame) -> float:
    """Strength of the prior over the groups of ``counts`` (n, k). One row of whole-number sums reaches the driver; squares are decimals of 38 digits."""
    wide = counts.where("n > 0").select("n", "k", *[F.col(c).cast("decimal(16,0)").alias(f"w{c}") for c in ("n", "k")])
    row = wide.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("n").alias("groups"), F.sum(F.expr("wn * wn")).alias("square"),
                   F.sum(F.expr("cast((wk * wk * 1000000) div wn as decimal(24,0))")).alias("spread")).first()
    return strength(row["n"] or 0, row["k"] or 0, row["groups"], float(row["square"] or 0), float(row["spread"] or 0) / 1e6)


def host_reputation(pages: DataFrame, host: str = "host", bad: str = "bad", z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, k, rate, bound) of every host: labelled pages, bad ones, posterior rate and its lower bound, rounded to 6 digits.

    ``suffixes(suffix)`` is the table of public suffixes (without it: a few). ``bad`` is true, false, or null without a label. Hosts without labelled pages get the rate of their domain. Null hosts count as the
    empty host. Counts are summed before the shuffle, so one host may hold any share of the pages.
    """
    n, k = F.count(bad), F.count(F.when(F.col(bad), 1))
    counted = stage(pages.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(n.alias("n"), k.alias("k")))
    if suffixes is None:
        suffixes = pages.sparkSession.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    hosts = stage(with_suffix(counted, suffixes))
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = stage(total(hosts, "domain", "suffix"))
    suffixes = stage(total(domains, "suffix"))
    row = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((row["k"] or 0) + 1) / ((row["n"] or 0) + 2)
    by_host, by_domain, by_suffix = level_strength(hosts), level_strength(domains), level_strength(suffixes)
    shrunk = lambda a, prior: (F.col("k") + a * prior) / (F.col("n") + a)
    suffixes = suffixes.select("suffix", shrunk(by_suffix, F.lit(overall)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(by_domain, F.col("suffix_rate")).alias("domain_rate"))
    rate = F.col("rate")
    return (hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", shrunk(by_host, F.col("domain_rate")).alias("rate"))
            .select("host", "n", "k", F.round(rate, 6).alias("rate"),
                    F.round(rate - z * F.sqrt(rate * (1 - rate) / (F.col("n") + by_host + 1)), 6).alias("bound")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5,
                key: str = "page_id", url: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, rate, bound) of every page: the longest fitting rule decides, else the host's reputation.

    ``outcomes`` has (key, bad). Null urls and urls without :// have an empty host and path and meet no rule. Repeated pages are judged
    alike; of several outcomes of a page a bad one counts. Pages and outcomes may hold further columns. Empty tables give no rows.
    """
    known = outcomes.where(F.col("bad").isNotNull()).groupBy(key).agg(F.max("bad").alias("bad"))
    own = pages.select(key, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    reputation = stage(host_reputation(own.join(known, key, "left"), suffixes=suffixes))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return (own.join(reputation, "host").withColumn("__rule", rule)
            .select(key, "host", "path", F.col("__rule.rule").alias("rule"),
                    F.coalesce(F.col("__rule.verdict"), F.when(F.col("bound") >= threshold, "block").otherwise("allow")).alias("verdict"), "rate", "bound"))
