"""URL filter by rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (good or not) are counted by host. Beta-binomial priors shrink them in three steps: the
suffix towards the whole, the registered domain towards its suffix, the host towards its domain. Each step's prior
strength comes from how far the groups of that level spread beyond binomial noise (method of moments, one row of
sums). A host is blocked if mean + z standard deviations of its posterior lies below `least_good`; a page
that a rule fits gets the rule's verdict, and any other its host's.

Counts are summed by host before any shuffle; only hosts, not pages, meet in the shrinking joins. The pages' join
to host verdicts broadcasts verdicts of a counted, small number of blocked hosts, and is else a shuffled join whose
large partitions Spark splits.

Cases: a null url or one without :// has an empty host and path and is judged by the prior of the empty host; a
host of one label is its own domain and suffix; outcomes that are null or that differ for one page are left out; no
outcomes give allow; repeated pages are judged alike, and counted once for each row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, broadcast_if_small, table, written

#: (verdict, rule): host, then path from the first slash on. The longest rule wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
STRONGEST, WEAKEST = 1000.0, 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        name, slash, rest = r.partition("/")
        fits = F.concat(F.lit("."), host).endswith(f".{name}") & path.startswith(slash + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _level(host: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean m and prior strength of the good share over groups (n, k)."""
    s = groups.filter("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")
    ).first()
    if not s.g:
        return 1.0, WEAKEST
    m = s.k / s.n
    scale = s.n - s.nn / s.n
    if s.g < 2 or scale <= 0 or m in (0.0, 1.0):
        return m, STRONGEST
    spread = (s.kk - s.n * m * m - (s.g - 1) * m * (1 - m)) / (scale * m * (1 - m))  # share of variance between groups
    return m, STRONGEST if spread <= 0 else min(STRONGEST, max(WEAKEST, 1 / spread - 1))


def reputation(counts: DataFrame, z: float = 2.0) -> DataFrame:
    """counts (host, n, k) with the posterior's mean and upper bound."""
    named = written(counts.withColumns({"domain": _level(F.col("host"), 2), "suffix": _level(F.col("host"), 1)}), "url-hosts")
    domains = written(named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (m, s0), (_, s1), (_, s2) = _strength(suffixes), _strength(domains), _strength(named)
    suffixes = suffixes.select("suffix", ((F.col("k") + s0 * m) / (F.col("n") + s0)).alias("m0"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + s1 * F.col("m0")) / (F.col("n") + s1)).alias("m1"))
    a, b = F.col("k") + s2 * F.col("m1"), F.col("n") - F.col("k") + s2 * (1 - F.col("m1"))
    found = named.join(domains, "domain").withColumns({"_a": a, "_b": b})
    mean = F.col("_a") / (F.col("_a") + F.col("_b"))
    deviation = F.sqrt(mean * (1 - mean) / (F.col("_a") + F.col("_b") + 1))
    return found.select("host", "n", "k", mean.alias("mean"), (mean + z * deviation).alias("upper"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, least_good: float = 0.5, z: float = 2.0) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages. outcomes: (page_id, good 0 or 1)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = outcomes.filter(F.col("good").isin(0, 1)).groupBy("page_id").agg(F.min("good").alias("good"), F.max("good").alias("_most")).filter("good = _most")
    judged = parts.select("page_id", "host").join(marks.select("page_id", "good"), "page_id", "left")
    counts = judged.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    bad = written(reputation(counts, z).filter(F.col("upper") < least_good).select("host", F.lit(True).alias("_bad")), "url-bad")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_bad"), "block").otherwise("allow")
    return parts.join(broadcast_if_small(bad, bad.count(), 200_000), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes)


def _fits(rule: str) -> str:
    name, slash, rest = rule.partition("/")
    return f"ends_with('.' || host, '.{name}') AND starts_with(path, '{slash}{rest}')"


_ORDERED = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
_LEVEL = "SELECT count(*) AS g, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk FROM {} WHERE n > 0"
_STRONG = """SELECT CASE WHEN g = 0 THEN 1.0 ELSE k / n END AS m, CASE WHEN g = 0 THEN 2.0
  WHEN g < 2 OR n - nn / n <= 0 OR k = 0 OR k = n THEN 1000.0
  WHEN kk - n * (k / n) * (k / n) - (g - 1) * (k / n) * (1 - k / n) <= 0 THEN 1000.0
  ELSE least(1000.0, greatest(2.0, (n - nn / n) * (k / n) * (1 - k / n) / (kk - n * (k / n) * (k / n) - (g - 1) * (k / n) * (1 - k / n)) - 1)) END AS s FROM ({})"""
OP8_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)
),
marks AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
named AS (
  SELECT host, regexp_extract(host, '(^|\\.)([^.]*\\.[^.]*|[^.]*)$', 2) AS domain, regexp_extract(host, '[^.]*$') AS suffix,
         CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k
  FROM parts LEFT JOIN marks USING (page_id) GROUP BY host
),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
z0 AS ({_STRONG.format(_LEVEL.format('suffixes'))}), z1 AS ({_STRONG.format(_LEVEL.format('domains'))}), z2 AS ({_STRONG.format(_LEVEL.format('named'))}),
m0 AS (SELECT suffix, (k + s * m) / (n + s) AS m0 FROM suffixes, z0),
m1 AS (SELECT domain, (k + s * m0) / (n + s) AS m1 FROM domains JOIN m0 USING (suffix), z1),
post AS (SELECT host, k + s * m1 AS a, n - k + s * (1 - m1) AS b FROM named JOIN m1 USING (domain), z2),
bad AS (SELECT host FROM post WHERE a / (a + b) + 2.0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) < 0.5)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _ORDERED)} END AS rule,
  CASE {' '.join(f"WHEN {_fits(r)} THEN '{v}'" for v, r in _ORDERED)} WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
