"""URL filter: rules, then an empirical-Bayes reputation of the host.

Labelled outcomes (bad or not) are counted by host, registered domain and suffix. Each level's rate is shrunk towards
its parent's through a beta prior whose strength comes from the data: with n outcomes and k bad in a group whose parent
has mean m, E[(k - n m)^2 / n] = m (1 - m) (1 + (n - 1) rho), which summed over the level's groups gives rho, and the
prior weighs 1 / rho - 1 outcomes. A host is blocked when the lower bound (mean - Z * deviation) of its posterior
reaches the threshold. Counts are integers, so they do not depend on how the rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lower_ascii, materialize

#: (pattern, verdict): host, then path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
THRESHOLD = 0.2
Z = 1.645
RHO = (0.0001, 0.5)
RHO_UNKNOWN = 0.1
#: A country's two letters and one of these before them are one suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "mil", "ne", "net", "nom", "or", "org")
#: The suffix of all numeric addresses, each of which is a domain of its own.
ADDRESS = "(address)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix, without user, port and final dot. The suffix is the last label, or the last two as in
    SECOND_LEVEL; the domain has one label more, if there is one. Addresses (four numbers, or in brackets) are domains."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(host, "[^@]*$", 0), ":[0-9]*$", ""), r"\.$", "")
    address = name.rlike(r"^([0-9]+\.){3}[0-9]+$") | name.startswith("[")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    two = (n >= 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    of = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    return F.when(address, name).when(two, of(3)).otherwise(of(2)), F.when(address, ADDRESS).when(two, of(2)).otherwise(of(1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (the host or any parent domain, and the path's start), and its verdict."""
    rule = verdict = None
    for pattern, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = pattern.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, pattern) if rule is None else rule.when(fits, pattern)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _strength(level: DataFrame) -> DataFrame:
    """One row: the weight of the prior for groups with columns n, k and the parent's mean m."""
    has = level.where("n > 0")
    sums = has.agg(
        F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 / F.col("n")).alias("seen"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)).alias("scale"),
    )
    rho = F.when(F.col("scale") > 0, F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), (F.col("seen") - F.col("within")) / F.col("scale")))).otherwise(F.lit(RHO_UNKNOWN))
    return sums.select((1 / rho - 1).alias("s"))


def _shrink(level: DataFrame) -> DataFrame:
    """Posterior a and b of each group, and its mean as `mean`."""
    fitted = level.crossJoin(F.broadcast(_strength(level)))  # one row
    a, b = F.col("s") * F.col("m") + F.col("k"), F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("k")
    return fitted.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, k, mean, bound of every host in `outcomes` (host, n labelled, k bad; any number of rows a host).

    A host without outcomes gets its domain's prior. Domains and suffixes are those of `domain_of`. Counts by host, then by
    domain, are written to the shared folder, so that the outcomes are read once.
    """
    domain, suffix = domain_of(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    hosts = hosts.drop("suffix")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    root = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m"))
    suffixes = materialize(_shrink(suffixes.crossJoin(F.broadcast(root))), "suffix-rates")  # root: one row
    domains = materialize(_shrink(materialize(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"), "domain-means")), "domain-rates")
    hosts = _shrink(materialize(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"), "host-means"))
    spread = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) ** 2 * (F.col("a") + F.col("b") + 1)))
    return hosts.select("host", "n", "k", "mean", (F.col("mean") - Z * spread).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_bound of every page.

    pages: page_id, url; labels: page_id, bad (0 or 1; null is no outcome). Several labels of a page count one by one, a
    null page_id matches none, pages with equal ids each get every label of the id. A null or malformed url has an empty
    host, which has a reputation like any other. Other columns are not read. Pages meet their host's reputation in a
    sort-merge join whose hot keys Spark may split: no aggregation stands above it.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    counts = urls.select("page_id", "host").join(known, "page_id", "left")
    counts = counts.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    judged = urls.join(materialize(reputation(counts), "host-rates"), "host", "left")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("bound") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("bad_mean"), F.round("bound", 6).alias("bad_bound"))


def _level_sql(name: str, source: str, key: str) -> str:
    """The SQL of one level: `source` has key, n, k, m."""
    return f"""
{name}_s AS (SELECT 1.0 / (CASE WHEN sum(m * (1 - m) * (n - 1)) FILTER (n > 0) > 0 THEN greatest({RHO[0]}, least({RHO[1]},
  (sum((k - n * m) ^ 2 / n) FILTER (n > 0) - sum(m * (1 - m)) FILTER (n > 0)) / sum(m * (1 - m) * (n - 1)) FILTER (n > 0))) ELSE {RHO_UNKNOWN} END) - 1 AS s FROM {source}),
{name} AS (SELECT {key}, n, k, s * m + k AS a, s * (1 - m) + n - k AS b, (s * m + k) / (s + n) AS mean FROM {source}, {name}_s)"""


_CASES = sorted(RULES, key=lambda r: -len(r[0]))
_FITS = [(p, v, f"((host = '{p.partition('/')[0]}' OR ends_with(host, '.{p.partition('/')[0]}')) AND starts_with(path, '/{p.partition('/')[2]}'))") for p, v in _CASES]

ORACLE = rf"""
WITH rests AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS k FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts0 AS (SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS k FROM urls LEFT JOIN known USING (page_id) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', ''), '\.$', '') AS name FROM hosts0),
labelled AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^([0-9]+\.){{3}}[0-9]+$') OR starts_with(name, '[') AS address FROM named),
suffixed AS (SELECT *, CASE WHEN len(l) >= 2 AND strlen(l[-1]) = 2 AND l[-2] IN {SECOND_LEVEL} THEN 2 ELSE 1 END AS d FROM labelled),
hosts1 AS (SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(l[-(d + 1):], '.') END AS domain, CASE WHEN address THEN '{ADDRESS}' ELSE array_to_string(l[-d:], '.') END AS suffix FROM suffixed),
domains0 AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts1 GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains0 GROUP BY suffix),
suffixes1 AS (SELECT *, (SELECT (sum(k) + 1.0)::DOUBLE / (sum(n) + 2)::DOUBLE FROM suffixes0) AS m FROM suffixes0),{_level_sql("suffixes2", "suffixes1", "suffix")},
domains1 AS (SELECT d.*, x.mean AS m FROM domains0 d JOIN suffixes2 x USING (suffix)),{_level_sql("domains2", "domains1", "domain")},
hosts3 AS (SELECT h.*, x.mean AS m FROM hosts1 h JOIN domains2 x USING (domain)),{_level_sql("hosts4", "hosts3", "host")},
rep AS (SELECT host, mean, mean - {Z} * sqrt(a * b / ((a + b) ^ 2 * (a + b + 1))) AS bound FROM hosts4)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{p}'" for p, _, f in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for _, v, f in _FITS)} WHEN bound >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS bad_mean, round(bound, 6) AS bad_bound
FROM urls LEFT JOIN rep USING (host)
"""
