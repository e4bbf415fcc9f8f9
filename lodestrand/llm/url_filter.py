"""URL filters: rules by host and path, and for other pages the reputation of their host.

Labelled pages are good or bad outcomes of their host. Rates are shrunk along suffix, registered domain and host: each
level's prior is a beta distribution around the posterior mean of the level above, its strength estimated from how much
rates differ between the level's members (a beta-binomial moment estimate). A page without a rule is blocked if its
host's rate of bad pages is above ``LIMIT`` even at the lower bound of the posterior. A host without outcomes has the
posterior of its domain, a new domain that of its suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import ascii_lower, materialize, table

#: (host, path, verdict) of each rule; the host's subdomains are included.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Second-level names under which two-letter suffixes register domains.
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
#: Share of bad pages that a host must exceed, standard deviations to the bound, limits of the moment estimate.
LIMIT, DEVIATIONS, LEAST_RHO, MOST_RHO = 0.5, 1.645, 0.001, 0.9
#: Where the sample tables' pages have the number of the document that they show (at sf0.1 2,499 of 2,500 titles begin as
#: the text of that document does).
DOCUMENT_IN_PATH = r"^/[a-z]{2}/([0-9]{1,18})(?:[/.]|$)"
#: Parts of a hot host's pages in the join with blocked hosts.
SALT = 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    """The registered domain: the last two names, three under a second-level suffix; numeric addresses are their own."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    three = F.regexp_extract(bare, rf"([^.]+\.(?:{SECOND_LEVEL})\.[a-z][a-z])$", 1)
    two = F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)
    return F.when(bare.rlike(r"^[0-9.]+$"), bare).when(three != "", three).when(two != "", two).otherwise(bare)


def suffix_of(domain: Column) -> Column:
    """What follows a registered domain's first name; empty for a numeric address."""
    return F.when(domain.rlike(r"^[0-9.]+$"), F.lit("")).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def _strength(level: DataFrame) -> float:
    """Pseudo-counts of the level's prior, from columns n, k and prior (mean of the level above): one row on the driver."""
    p = F.col("prior") * (1 - F.col("prior"))
    q = F.sum(F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - F.col("n") * p)
    r = level.agg(q.alias("q"), F.sum(F.col("n") * (F.col("n") - 1) * p).alias("b")).first()
    rho = min(max(r["q"] / r["b"], LEAST_RHO), MOST_RHO) if r["b"] else MOST_RHO
    return 1 / rho - 1


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, mean, bound) from (host, n, k): labelled pages of each host and the bad ones among them (both may be 0).

    Each level is written once, and its strength read off it: three rows reach the driver. An empty table gives none.
    """
    domain = domain_of(F.col("host"))
    own = materialize(hosts.select("host", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")).withColumn("domain", domain).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    by_domain = materialize(own.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = by_domain.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()

    def posterior(level: DataFrame, strength: float) -> DataFrame:
        return level.withColumn("mean", (F.col("k") + strength * F.col("prior")) / (F.col("n") + strength)).withColumn("size", F.col("n") + strength)

    suffixes = by_suffix.withColumn("prior", F.lit((whole["k"] + 0.5) / (whole["n"] + 1)))
    suffixes = posterior(suffixes, _strength(suffixes))
    domains = materialize(by_domain.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), "priors")
    domains = posterior(domains, _strength(domains))
    ranked = materialize(own.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "ranked")
    mean = F.col("mean")
    return posterior(ranked, _strength(ranked)).select("host", "mean", (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (F.col("size") + 1))).alias("bound"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k) of pages whose path holds a labelled document's number: bad if any label says quality 0 or toxic 1.

    Labels without a doc_id, or that say nothing of either, are not outcomes. Repeated pages count each.
    """
    host, path = parts(F.col("url"))
    doc = F.regexp_extract(path, DOCUMENT_IN_PATH, 1)
    counted = pages.select(host.alias("host"), F.when(doc != "", doc.cast("long")).alias("doc")).where("doc is not null").groupBy("host", "doc").agg(F.count("*").alias("pages"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(bad.alias("bad")).where("bad is not null")
    return counted.join(known, "doc").groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("k"))


def judge(pages: DataFrame, known: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``; other columns are not read.

    ``known``: (host, n, k), outcomes of hosts, also of such as have no page here. A null url, an empty one or one without
    ``://`` has an empty host and path, no rule, and is judged by the reputation of the empty host. Without outcomes
    nothing is blocked but by rules. Of rules of one length, which only a repeated rule can have, the last counts. Urls of
    any length are read whole. Repeated rows stay.
    """
    host, path = parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.col("__rule.verdict")
    if known is None:
        return own.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(ruled, F.lit("allow")).alias("verdict"))
    none = F.lit(0).cast("long")
    hosts = own.where(ruled.isNull()).select("host").distinct().select("host", none.alias("n"), none.alias("k")).unionByName(known.where("host is not null").select("host", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")))
    bad = reputation(hosts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))).where(F.col("bound") > LIMIT)
    # only blocked hosts are copied for each part of a hot host's pages
    bad = bad.select(F.col("host").alias("__host"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    own = own.withColumn("__part", F.when(ruled.isNull(), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")))
    return own.join(bad, (F.col("host") == F.col("__host")) & (F.col("__part") == F.col("__salt")), "left").select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(ruled, F.when(F.col("__host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, outcomes(pages, table(spark, sf_dir, "labels")))


OP10_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS a FROM pages),
p AS (SELECT page_id, translate(regexp_extract(a, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, v)),
hp AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS rule_verdict FROM hp JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
good AS (SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
l AS (SELECT host, bad FROM p LEFT JOIN good ON good.doc = TRY_CAST(nullif(regexp_extract(path, '^/[a-z]{2}/([0-9]{1,18})(?:[/.]|$)', 1), '') AS BIGINT)),
lone AS (SELECT DISTINCT host FROM p LEFT JOIN best USING (host, path) WHERE rule IS NULL),
h0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(bad) AS n, count(*) FILTER (bad = 1) AS k FROM l GROUP BY 1, 2 HAVING count(bad) > 0 OR host IN (SELECT host FROM lone)),
h1 AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare WHEN regexp_extract(bare, '([^.]+\.(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z])$', 1) <> '' THEN regexp_extract(bare, '([^.]+\.(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z])$', 1) WHEN regexp_extract(bare, '([^.]+\.[^.]+)$', 1) <> '' THEN regexp_extract(bare, '([^.]+\.[^.]+)$', 1) ELSE bare END AS domain FROM h0),
h AS (SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+$') THEN '' ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix FROM h1),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM h) AS prior FROM h GROUP BY 1),
ss AS (SELECT 1 / coalesce(CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0 THEN least(greatest(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)), 0.001), 0.9) END, 0.9) - 1 AS g FROM s),
sm AS (SELECT suffix, (k + g * prior) / (n + g) AS m FROM s, ss),
d AS (SELECT domain, any_value(m) AS prior, sum(n) AS n, sum(k) AS k FROM h JOIN sm USING (suffix) GROUP BY 1),
ds AS (SELECT 1 / coalesce(CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0 THEN least(greatest(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)), 0.001), 0.9) END, 0.9) - 1 AS g FROM d),
dm AS (SELECT domain, (k + g * prior) / (n + g) AS prior FROM d, ds),
x AS (SELECT host, n, k, prior FROM h JOIN dm USING (domain)),
xs AS (SELECT 1 / coalesce(CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0 THEN least(greatest(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)), 0.001), 0.9) END, 0.9) - 1 AS g FROM x),
b AS (SELECT host, (k + g * prior) / (n + g) AS m, n + g AS size FROM x, xs)
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (host, path) LEFT JOIN b ON b.host = p.host
"""
