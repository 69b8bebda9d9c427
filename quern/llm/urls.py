"""URL filters: prefix rules first, then an empirical-Bayes reputation of hosts.

The pages that a rule settles are the labelled outcomes (block = 1, allow = 0).
Each level's rate is shrunk to its parent's by a beta prior: all pages to the
suffix, the suffix to the registered domain, the domain to the host.  A prior's
strength comes from the spread between the children of that level (method of
moments, held between 1 and 1000 pseudo-pages, where the moments give no usable
value), so noisy levels lean on their parents.  A page without a rule is
blocked if its host's posterior block rate exceeds one half by ``z`` posterior
deviations, else allowed.

Everything is DataFrame code.  Pages are pre-aggregated by host before any
shuffle; the host table joins back by broadcast when its counted size allows,
else by a shuffle that adaptive execution may split.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule, and is judged as host '' like any other; hosts of one label are their own
suffix and domain; without labelled pages the rate is one half and nothing is
blocked; repeated rows each give a row, an empty table none; of rules that fit, the
longest wins, and no two are equally long for one url; very long urls are handled
whole; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, maybe_broadcast

#: (verdict, host and path prefix) of the contract.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Second-level labels under which domains are registered in country suffixes.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many become one expression; more are joined.
EXPRESSION_RULES = 200


def host_path(url: str) -> tuple[Column, Column]:
    c = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(c, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column, what: int) -> Column:
    """The longest fitting rule's verdict (what = 0) or text (what = 1), null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = split_rule(rule[1])
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def join_rules(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """As ``rule_column`` for a rule table (verdict, rule) of any size: joins the host's
    suffixes to the rules' hosts, keeps fitting prefixes, and the longest per ``key``."""
    listed = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = pages.select(key, "path", F.explode(suffixes).alias("suffix")).join(listed, "suffix").filter("startswith(path, prefix)")
    best = fits.groupBy(key).agg(F.max_by(F.struct("verdict", "rule"), F.struct(F.length("rule"), "rule")).alias("best"))
    return pages.join(best, key, "left").select(*pages.columns, F.col("best.verdict").alias("verdict"), F.col("best.rule").alias("rule"))


def suffix_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix (last label, or the last two under a country's second level) and registered domain."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, -2).otherwise(-1)).isin(SECOND_LEVEL)
    depth = F.when(two, 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return tail(depth), tail(depth + 1)


def strength(rates: DataFrame) -> tuple[float, float]:
    """(overall rate, prior strength) from children (n, k): the beta-binomial's moments."""
    r = rates.filter("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("c"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q")).first()
    if not r["n"]:
        return 0.5, 1.0
    p = r["k"] / r["n"]
    within = p * (1 - p) * r["c"] / r["n"]
    between = max(r["q"] / r["n"] - p * p - within, 1e-6)
    return p, min(max(p * (1 - p) / between - 1, 1.0), 1000.0)


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, rate, deviation from rows (host, n, k): pages labelled and pages blocked."""
    suffix, domain = suffix_domain(F.col("host"))
    hosts = outcomes.select("host", "n", "k", suffix.alias("suffix"), domain.alias("domain"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    p0, m_suffix = strength(suffixes.select(F.col("sn").alias("n"), F.col("sk").alias("k")))
    _, m_domain = strength(domains.select(F.col("dn").alias("n"), F.col("dk").alias("k")))
    _, m_host = strength(hosts)
    shrunk = lambda k, n, m, p: (F.col(k) + F.lit(m) * p) / (F.col(n) + F.lit(m))
    suffixes = suffixes.select("suffix", shrunk("sk", "sn", m_suffix, F.lit(p0)).alias("sp"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk("dk", "dn", m_domain, F.col("sp")).alias("dp"))
    at = hosts.join(domains, ["suffix", "domain"]).withColumn("rate", shrunk("k", "n", m_host, F.col("dp")))
    return at.select("host", "rate", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(m_host) + 1)).alias("deviation"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, z: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound of every page (page_id, url)."""
    host, path = host_path("url")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) <= EXPRESSION_RULES:
        ruled = parts.withColumn("rule", rule_column(rules, F.col("host"), F.col("path"), 1)).withColumn("ruled", rule_column(rules, F.col("host"), F.col("path"), 0))
    else:
        listed = pages.sparkSession.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")
        places = parts.select("host", "path").distinct().withColumn("place", F.struct("host", "path"))
        ruled = parts.join(join_rules(places, listed, "place").select("host", "path", "rule", F.col("verdict").alias("ruled")), ["host", "path"])
    known = ruled.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("k"))
    known = materialize(known, "hosts")
    scored = materialize(reputations(known), "reputations")
    at = ruled.join(maybe_broadcast(scored, 128), "host", "left")
    bound = F.col("rate") - F.lit(z) * F.col("deviation")
    verdict = F.coalesce(F.col("ruled"), F.when(bound > 0.5, "block").otherwise("allow"))
    return at.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("rate", 6).alias("rate"), F.round(bound, 6).alias("bound"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts),
rules(v, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fit AS (
  SELECT page_id, arg_max(v, length(rule)) AS ruled, arg_max(rule, length(rule)) AS rule
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
ruled AS (SELECT hp.page_id, host, path, rule, ruled FROM hp LEFT JOIN fit USING (page_id)),
labels AS (SELECT host, string_split(host, '.') AS l, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS k FROM ruled GROUP BY host),
depth AS (SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac','co','com','edu','gov','net','or','org') THEN 2 ELSE 1 END AS d FROM labels),
hosts AS (SELECT host, n, k, array_to_string(l[greatest(len(l) - d + 1, 1):], '.') AS suffix, array_to_string(l[greatest(len(l) - d, 1):], '.') AS domain FROM depth),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
kids AS (SELECT 's' AS lv, n, k FROM suffixes UNION ALL SELECT 'd', n, k FROM domains UNION ALL SELECT 'h', n, k FROM hosts),
sums AS (SELECT lv, sum(k)::DOUBLE / sum(n) AS p, count(*)::DOUBLE / sum(n) AS c, sum(k::DOUBLE * k / n) / sum(n) AS q FROM kids WHERE n > 0 GROUP BY lv),
prior AS (SELECT lv, p, least(greatest(p * (1 - p) / greatest(q - p * p - p * (1 - p) * c, 1e-6) - 1, 1.0), 1000.0) AS m FROM sums),
pr AS (SELECT coalesce(max(p) FILTER (lv = 's'), 0.5) AS p0, coalesce(max(m) FILTER (lv = 's'), 1.0) AS ms, coalesce(max(m) FILTER (lv = 'd'), 1.0) AS md, coalesce(max(m) FILTER (lv = 'h'), 1.0) AS mh FROM prior),
sp AS (SELECT suffix, (k + ms * p0) / (n + ms) AS sp FROM suffixes, pr),
dp AS (SELECT suffix, domain, (k + md * sp) / (n + md) AS dp FROM domains JOIN sp USING (suffix), pr),
rate AS (SELECT host, n, mh, (k + mh * dp) / (n + mh) AS rate FROM hosts JOIN dp USING (suffix, domain), pr),
fin AS (SELECT host, rate, rate - sqrt(rate * (1 - rate) / (n + mh + 1)) AS bound FROM rate)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS rate, round(bound, 6) AS bound
FROM ruled JOIN fin USING (host)
"""
