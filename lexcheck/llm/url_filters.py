"""URL filters: explicit host/path rules first, then an empirical-Bayes host reputation.

Labelled page outcomes (1 = bad) are counted per host, registered domain and public suffix. Each
level's rate is shrunk toward its parent's with a beta-binomial prior whose strength comes from the
spread of the children's rates (method of moments); a page is blocked when the lower posterior bound
of its host's bad rate exceeds a threshold. Everything is DataFrame expressions.

Defined cases: null url or no ``://`` gives empty host and path, no rule fits and the root posterior
decides; unlabelled hosts take their parent's posterior; repeated rows are judged alike and, where they have
outcomes, counted each; outcomes without a page number or a value, and those of no page, count for nothing;
without outcomes every bound is that of the root's one good and one bad page; extra columns are ignored; an
empty table of pages gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.common import discard, materialise, only, table

#: Fixed values of the query's contract: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels, unless others are given (a longer list is an argument of ``judge_urls``); any other
#: suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null: a chain tried longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        said = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, said).otherwise(out)
    return out


def _shrunk(level: DataFrame, parent: DataFrame, key: str, parent_key: str | None) -> DataFrame:
    """(key, n, bad, alpha, beta): the level's counts on top of its parent's prior.

    The prior strength of the level is estimated over all its keys: with parent rates m and
    var = sum n (p - m)^2 / sum n, strength = sum m(1-m) n / sum var n - 1, clamped."""
    joined = level.crossJoin(parent) if parent_key is None else level.join(parent, parent_key)
    p, m, n = F.col("bad") / F.col("n"), F.col("mean"), F.col("n")
    moments = joined.agg(
        F.sum(m * (1 - m) * n).alias("_expected"), F.sum(n * (p - m) * (p - m)).alias("_spread")
    ).select(
        F.greatest(
            F.lit(LEAST_STRENGTH),
            F.least(
                F.lit(MOST_STRENGTH),
                F.when(F.col("_spread") > 0, F.col("_expected") / F.col("_spread") - 1).otherwise(F.lit(MOST_STRENGTH)),
            ),
        ).alias("strength")
    )
    # one-row frame on the right: a constant, not a cross product of tables
    return joined.crossJoin(F.broadcast(moments)).select(
        key,
        (m * F.col("strength") + F.col("bad")).alias("alpha"),
        ((1 - m) * F.col("strength") + F.col("n") - F.col("bad")).alias("beta"),
    )


def host_reputation(pages: DataFrame, outcomes: DataFrame, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> dict[str, DataFrame]:
    """``pages(page_id, url)`` and ``outcomes(page_id, bad)`` to posteriors (alpha, beta) by level. Each level is
    written once: the next one and the judgement both read it. They have a row per host at most."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"))
    counts = (
        urls.join(outcomes, "page_id")
        .groupBy("host")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
        .select("host", domain_of(F.col("host"), two_label).alias("domain"), suffix_of(F.col("host"), two_label).alias("suffix"), "n", "bad")
    )
    counts = materialise(counts)
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    # one labelled-free virtual bad and good page keep the root rate inside (0, 1)
    root = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("_n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("_b")).select(
        ((F.col("_b") + 1) / (F.col("_n") + 2)).alias("mean"), (F.col("_b") + 1).alias("alpha"), (F.col("_n") - F.col("_b") + 1).alias("beta")
    )
    root = materialise(root)
    mean = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean")
    suffixes = materialise(_shrunk(counts.groupBy("suffix").agg(*add), F.broadcast(root.select("mean")), "suffix", None))
    domains = materialise(_shrunk(counts.groupBy("domain", "suffix").agg(*add), suffixes.select("suffix", mean), "domain", "suffix"))
    hosts = materialise(_shrunk(counts, domains.select("domain", mean), "host", "domain"))
    discard(counts)
    return {"root": root.select("alpha", "beta"), "suffix": suffixes, "domain": domains, "host": hosts}


def lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Normal approximation of the beta posterior's lower credible bound."""
    total = alpha + beta
    return alpha / total - F.lit(z) * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    threshold: float = 0.25,
    z: float = 1.645,
    two_label: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate_bound (the posterior's lower bound of the host's bad rate, also
    where a rule decides) for every row of ``pages``.

    The reputation is joined by host after the pages were reduced to their distinct hosts, so a host
    with a third of all pages is one row in every reputation join; the join back to the pages is an
    equi-join whose small side is unique per host."""
    pages = only(pages, "page_id", "url")
    outcomes = only(outcomes, "page_id", "bad").filter("page_id is not null and bad is not null")
    levels = host_reputation(pages, outcomes, two_label)
    hosts = (
        pages.select(host_of(F.col("url")).alias("host"))
        .distinct()
        .select("host", domain_of(F.col("host"), two_label).alias("domain"), suffix_of(F.col("host"), two_label).alias("suffix"))
    )
    for level in ("host", "domain", "suffix"):
        hosts = hosts.join(levels[level].select(level, F.struct("alpha", "beta").alias(f"_{level}")), level, "left")
    best = F.coalesce("_host", "_domain", "_suffix", "_root")
    judged = hosts.crossJoin(F.broadcast(levels["root"].select(F.struct("alpha", "beta").alias("_root")))).select(
        "host", lower_bound(best["alpha"], best["beta"], z).alias("bad_rate_bound")
    )
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .join(judged, "host", "left")
        .withColumn("_rule", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_rate_bound") > threshold, "block").otherwise("allow")).alias("verdict"),
            "bad_rate_bound",
        )
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labelled quality of the page with the document's number (bad = quality 0)."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).withColumn("bad_rate_bound", F.round("bad_rate_bound", 6))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
parts AS (
  SELECT host, str_split(host, '.') AS l FROM (SELECT DISTINCT host FROM u)),
h AS (
  SELECT host, CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz') THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
         CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz') THEN two ELSE l[-1] END AS suffix
  FROM (SELECT host, l, array_to_string(l[-2:], '.') AS two FROM parts)),
c AS (
  SELECT h.host, any_value(h.domain) AS domain, any_value(h.suffix) AS suffix,
         count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS bad
  FROM u JOIN labels ON labels.doc_id = u.page_id JOIN h ON h.host = u.host
  WHERE quality IS NOT NULL GROUP BY h.host),
root AS (SELECT coalesce(sum(bad), 0) + 1 AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 1 AS b FROM c),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT a / (a + b) FROM root) AS m FROM c GROUP BY suffix),
sk AS (SELECT greatest(2.0, least(1000.0, CASE WHEN sum(n*(bad/n-m)*(bad/n-m)) > 0
        THEN sum(m*(1-m)*n) / sum(n*(bad/n-m)*(bad/n-m)) - 1 ELSE 1000.0 END)) AS k FROM s0),
s AS (SELECT suffix, m*k + bad AS a, (1-m)*k + n - bad AS b FROM s0, sk),
d0 AS (SELECT c.domain, c.suffix, sum(n) AS n, sum(bad) AS bad, any_value(s.a/(s.a+s.b)) AS m
       FROM c JOIN s ON s.suffix = c.suffix GROUP BY c.domain, c.suffix),
dk AS (SELECT greatest(2.0, least(1000.0, CASE WHEN sum(n*(bad/n-m)*(bad/n-m)) > 0
        THEN sum(m*(1-m)*n) / sum(n*(bad/n-m)*(bad/n-m)) - 1 ELSE 1000.0 END)) AS k FROM d0),
d AS (SELECT domain, m*k + bad AS a, (1-m)*k + n - bad AS b FROM d0, dk),
h0 AS (SELECT c.host, n, bad, d.a/(d.a+d.b) AS m FROM c JOIN d ON d.domain = c.domain),
hk AS (SELECT greatest(2.0, least(1000.0, CASE WHEN sum(n*(bad/n-m)*(bad/n-m)) > 0
        THEN sum(m*(1-m)*n) / sum(n*(bad/n-m)*(bad/n-m)) - 1 ELSE 1000.0 END)) AS k FROM h0),
hh AS (SELECT host, m*k + bad AS a, (1-m)*k + n - bad AS b FROM h0, hk),
j AS (
  SELECT h.host, coalesce(hh.a, d.a, s.a, root.a) AS a, coalesce(hh.b, d.b, s.b, root.b) AS b
  FROM h LEFT JOIN hh ON hh.host = h.host LEFT JOIN d ON d.domain = h.domain
         LEFT JOIN s ON s.suffix = h.suffix CROSS JOIN root),
r(verdict, rule_host, rule_path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'),
  ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
fit AS (
  SELECT page_id, u.host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM u LEFT JOIN r ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, u.host, path)
SELECT fit.page_id, fit.host, fit.path, fit.rule, round(a/(a+b) - 1.645 * sqrt(a*b/((a+b)*(a+b)*(a+b+1))), 6) AS bad_rate_bound,
  coalesce(fit.verdict, CASE WHEN a/(a+b) - 1.645 * sqrt(a*b/((a+b)*(a+b)*(a+b+1))) > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM fit JOIN j ON j.host = fit.host
"""
