"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

A url's host stands between its first ``://`` and the next ``/``, ``?``, ``#`` or
the end (A-Z lower-cased), its path from there to ``?``, ``#`` or the end. Null
urls and those without ``://`` have an empty host and path.

Rules are (verdict, host, path): one fits its host and all subdomains if the
path starts with the rule's; the longest that fits wins, host and path counted.

Other urls are judged by their host. Outcomes of labelled pages are counted by
host, registered domain and suffix. From the top down, a level's rate of good
pages is a beta-binomial posterior whose prior has its parent's rate as mean; the
prior's strength is fitted to each level by the method of moments, from
how far children's rates scatter about their parents' beyond chance. A host is
blocked if even the upper bound of its posterior, ``z`` standard
deviations above the mean, is below ``least``. Hosts without labels have their
domain's rate, with the prior's width.

Counts by host are partial aggregates, so a host with a third of all pages
costs no more than another; joins by host leave skew to AQE, as the host side is
distinct. A port is part of a host, but not of its domain and suffix. Suffixes are
the last label, or the last two where SECOND_LEVEL lists them: a stand-in, to be
replaced by a public list where one is at hand. Repeated rows are judged each; labels that repeat count each; null
labels don't. A null page_id has no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_type

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level suffixes under which domains are registered, besides the last label.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(name: Column) -> Column:
    """A host without its port."""
    return F.regexp_replace(name, r":\d*$", "")


def suffix(name: Column) -> Column:
    name = _bare(name)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def registered(name: Column) -> Column:
    """The suffix and one label more."""
    name = _bare(name)
    return F.when(F.substring_index(name, ".", -2).isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def best_rule(name: Column, where: Column, rules: tuple = RULES) -> Column:
    """The rule that wins, as a struct (size, rule, verdict), or null: looked up by the host's ends, however many rules there are."""
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entries = []
    for h, found in sorted(by_host.items()):
        entries += [F.lit(h), F.array(*(F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for p, v in found))]
    table = F.create_map(*entries)
    labels = F.split(name, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fit = F.filter(F.flatten(F.transform(F.filter(ends, lambda e: F.map_contains_key(table, e)), lambda e: F.element_at(table, e))), lambda r: where.startswith(r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _strength(children: DataFrame, least: float = 2.0, most: float = 1000.0) -> Column:
    """Prior strength a + b of children (good, n, prior), by moments of (rate - prior)**2 about its binomial variance.

    With phi = 1 / (a + b + 1), the expected square of (rate - prior) is
    prior (1 - prior) (1 + (n - 1) phi) / n; phi is what makes the sums over children of n times both sides agree.
    """
    p = F.col("prior")
    expected = F.sum(F.when(F.col("n") > 0, p * (1 - p)))
    more = F.sum(F.when(F.col("n") > 0, p * (1 - p) * (F.col("n") - 1)))
    square = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)))
    phi = F.least(F.greatest((square - expected) / F.when(more > 0, more), F.lit(1 / (most + 1))), F.lit(1 / (least + 1)))
    return 1 / F.coalesce(phi, F.lit(1 / (least + 1))) - 1


def reputation(hosts: DataFrame) -> DataFrame:
    """host, good, n, mean, sd of each host, of counts by host (host, good, n). Of each level one number comes to the driver, the prior's strength."""
    own = hosts.withColumns({"domain": registered(F.col("host")), "suffix": suffix(F.col("host"))})
    total = own.agg((F.sum("good") + 1) / (F.sum("n") + 2)).first()[0]

    def level(children: DataFrame) -> DataFrame:
        """rate and strength k of children that have a prior."""
        k = F.lit(children.agg(_strength(children)).first()[0])
        return children.withColumn("k", k).withColumn("rate", (F.col("prior") * F.col("k") + F.col("good")) / (F.col("k") + F.col("n")))

    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    suffixes = level(own.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(total).cast("double"))).select("suffix", F.col("rate").alias("prior"))
    domains = level(own.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")).select("domain", F.col("rate").alias("prior"))
    judged = level(own.join(domains, "domain"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("k") + F.col("n") + 1))
    return judged.select("host", "good", "n", F.col("rate").alias("mean"), sd.alias("sd"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good, n: labelled pages of each host, those of hosts without labels too. labels: doc_id is a page's id, quality 1 is good."""
    told = labels.select(F.col("doc_id").cast(id_type(pages, "page_id")).alias("page_id"), F.col("quality").cast("int").alias("q")).where("q IS NOT NULL").groupBy("page_id").agg(F.sum(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("n"))
    own = pages.select(F.col("page_id").cast(id_type(pages, "page_id")).alias("page_id"), host(F.col("url").cast("string")).alias("host"))
    joined = own.join(told, "page_id", "left")
    return joined.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, least: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, sd of each page."""
    hosts = reputation(cut(outcomes(pages, labels))).select("host", "mean", "sd")
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id").cast(id_type(pages, "page_id")).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    own = own.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    out = own.join(hosts, "host", "left")
    learnt = F.when(F.col("mean") + z * F.col("sd") < least, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), learnt).alias("verdict"), "mean", "sd")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, children: str) -> str:
    return f"""
{name}_k AS (SELECT 1 / coalesce(least(greatest((sum(CASE WHEN n > 0 THEN n * power(good / n - prior, 2) END) - sum(CASE WHEN n > 0 THEN prior * (1 - prior) END))
        / nullif(greatest(sum(CASE WHEN n > 0 THEN prior * (1 - prior) * (n - 1) END), 0), 0), 1 / 1001.0::DOUBLE), 1 / 3.0::DOUBLE), 1 / 3.0::DOUBLE) - 1 AS k FROM {children}),
{name} AS (SELECT c.*, k, (prior * k + good) / (k + n) AS rate FROM {children} c, {name}_k)"""


#: DuckDB's form of the digest, with RULES.
ORACLE = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
told AS (SELECT doc_id AS page_id, count(*) FILTER (quality = 1) AS good, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, coalesce(sum(n), 0)::DOUBLE AS n FROM p LEFT JOIN told USING (page_id) GROUP BY host),
parts AS (SELECT *, array_to_string(l[-2:], '.') IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) AS two FROM (SELECT host, good, n, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM h)),
own AS (SELECT host, good, n, array_to_string(CASE WHEN two THEN l[-3:] ELSE l[-2:] END, '.') AS domain, array_to_string(CASE WHEN two THEN l[-2:] ELSE l[-1:] END, '.') AS suffix FROM parts),
s0 AS (SELECT suffix, sum(good) AS good, sum(n) AS n, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM own) AS prior FROM own GROUP BY suffix),{_level_sql("s1", "s0")},
d0 AS (SELECT o.suffix, o.domain, sum(o.good) AS good, sum(o.n) AS n, any_value(s1.rate) AS prior FROM own o JOIN s1 USING (suffix) GROUP BY o.suffix, o.domain),{_level_sql("d1", "d0")},
h0 AS (SELECT o.host, o.good, o.n, d1.rate AS prior FROM own o JOIN d1 USING (domain)),{_level_sql("h1", "h0")},
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in RULES)}) r(v, h, q)),
best AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM (SELECT DISTINCT * FROM p) p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.v, CASE WHEN rate + 1.645 * sqrt(rate * (1 - rate) / (k + n + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) LEFT JOIN h1 USING (host)
"""
