"""URL filters: host reputation by empirical Bayes beside explicit rules, with DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix. The
prior of a suffix is the global bad rate, that of a domain the rate of its
suffix's other domains, that of a host the rate of its domain's other hosts, so
no outcome is counted twice. The strengths of the beta priors follow from how far
the groups of a level lie from the level above (method of moments), and are no
more than what those others know. A host is blocked if a low quantile of its
posterior bad rate is above the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import cut, read, without

#: (verdict, host and path prefix)
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: A host is blocked if its bad rate is above the limit with this probability; the normal deviate of that.
CERTAINTY = 0.9
DEVIATE = 1.2815515655446004
LIMIT = 0.5
#: Prior strengths lie between these.
WEAKEST, STRONGEST = 1.0, 1e4
# Suffixes of two labels under which names are registered.
TWO_LABELS = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx",
    "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "gov.au", "gov.uk", "me.uk", "ne.jp", "net.au", "net.cn", "net.nz", "or.jp", "or.kr", "org.au",
    "org.cn", "org.nz", "org.uk",
)
#: Hosts whose reputation may be broadcast; with more it is joined by a shuffle.
BROADCAST_HOSTS = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(F.coalesce(url, F.lit("")), at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where names are registered under them."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS) & (two != host), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    long_ = F.substring_index(host, ".", -2).isin(*TWO_LABELS) & (F.substring_index(host, ".", -2) != host)
    return F.when(long_, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def strength(groups: DataFrame, x: str, n: str, centre: Column) -> float:
    """Pseudo-count of a level's beta priors by the method of moments, from sums over its groups."""
    within, between, labels, size = groups.where(F.col(n) > 1).agg(
        F.avg(centre * (1 - centre)), F.sum(F.col(n) * F.pow(F.col(x) / F.col(n) - centre, F.lit(2))), F.sum(n), F.count("*")
    ).first()
    if not within:
        return WEAKEST
    excess = (between / labels - within / (labels / size)) / within
    return min(STRONGEST, max(WEAKEST, 1 / excess - 1)) if excess > 1e-4 else STRONGEST


def low_quantile(a: Column, b: Column, deviate: float = DEVIATE) -> Column:
    """Quantile of a beta distribution that lies ``deviate`` below its middle, by the usual normal approximation of its log odds (Abramowitz and Stegun 26.5.22, parameters of at least 1)."""
    p, q = (1 / (2 * F.greatest(x, F.lit(1.0)) - 1) for x in (a, b))
    h, k = 2 / (p + q), (deviate * deviate - 3) / 6
    w = deviate * F.sqrt(h + k) / h - (q - p) * (k + 5 / 6 - 2 / (3 * h))
    a, b = F.greatest(a, F.lit(1.0)), F.greatest(b, F.lit(1.0))
    return a / (a + b * F.exp(2 * w))


def reputation(outcomes: DataFrame, deviate: float = DEVIATE) -> DataFrame:
    """For each host of ``outcomes(host, bad)``: counts, posterior bad rate and a low quantile of it.

    ``bad`` is 0, 1 or null (unlabelled: such hosts get the rate of their domain's
    others). The counts are partial sums before the only shuffle, so a hot host is
    one row a task; a repeated row counts each time.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"))
    hosts = cut(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "x"))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx")))
    total = suffixes.agg(F.coalesce(F.sum("sx"), F.lit(0)), F.coalesce(F.sum("sn"), F.lit(0))).first()
    base = (total[0] + 1.0) / (total[1] + 2.0)
    ks = strength(suffixes, "sx", "sn", F.lit(base))
    of = lambda x, n, prior, k: (F.col(x) + F.lit(k) * prior) / (F.col(n) + F.lit(k))
    domains = domains.join(suffixes, "suffix").withColumn("suffix_rate", of("sx", "sn", F.lit(base), ks))
    kd = strength(domains, "dx", "dn", F.col("suffix_rate"))
    others = F.col("sn") - F.col("dn") + F.lit(ks)
    domains = domains.withColumn("dk", 1 / (1 / F.lit(kd) + 1 / others)).withColumn("dp", (F.col("sx") - F.col("dx") + F.lit(ks * base)) / others)
    domains = domains.withColumn("domain_rate", (F.col("dx") + F.col("dk") * F.col("dp")) / (F.col("dn") + F.col("dk")))
    rows = hosts.join(domains.drop("suffix"), "domain")
    kh = strength(rows, "x", "n", F.col("domain_rate"))
    others = F.col("dn") - F.col("n") + F.col("dk")
    rows = rows.withColumn("k", 1 / (1 / F.lit(kh) + 1 / others)).withColumn("p", (F.col("dx") - F.col("x") + F.col("dk") * F.col("dp")) / others)
    a, b = F.col("x") + F.col("k") * F.col("p"), F.col("n") - F.col("x") + F.col("k") * (1 - F.col("p"))
    return rows.select("host", "n", "x", (a / (a + b)).alias("rate"), low_quantile(a, b, deviate).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, deviate: float = DEVIATE, limit: float = LIMIT) -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule``, ``bad_rate`` and ``verdict``.

    ``outcomes(url, bad)`` are the labelled pages. A null url, or one without
    ``://``, has an empty host and path, and is judged like any host. Hosts
    without labels get the rate of their domain, suffix or the whole. Repeated
    rows are judged alike; a long url is read whole. Columns of ``pages`` named
    like an added one are replaced; empty tables give empty ones.
    """
    data = without(pages, "host", "path", "rule", "bad_rate", "verdict")
    split = data.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    judged = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    seen = judged.unionByName(split.groupBy("host").agg(F.lit(None).cast("long").alias("bad")))
    known = cut(reputation(seen, deviate))
    small = known.select(F.col("host").alias("__host"), "rate", "bound")
    joined = split.join(F.broadcast(small) if known.count() <= BROADCAST_HOSTS else small, F.col("host") == F.col("__host"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(*[F.col(f"`{c}`") for c in split.columns], rule.alias("rule"), F.col("rate").alias("bad_rate"), F.coalesce(verdict, learnt).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", bad.alias("bad"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _strength(table: str, name: str) -> str:
    """The prior strength of a level, from the groups ``table(gx, gn, centre)``."""
    return f"""{table}_m AS (SELECT avg(centre * (1 - centre)) AS w, sum(gn * pow(gx / gn - centre, 2)) AS v, sum(gn) AS l, count(*) AS c FROM {table} WHERE gn > 1),
{table}_e AS (SELECT w, (v / l - w / (l / c)) / nullif(w, 0) AS excess FROM {table}_m),
{table}_k AS (SELECT CASE WHEN coalesce(w, 0) = 0 THEN {WEAKEST}::DOUBLE WHEN excess > 1e-4 THEN least({STRONGEST}::DOUBLE, greatest({WEAKEST}::DOUBLE, 1 / excess - 1)) ELSE {STRONGEST}::DOUBLE END AS {name} FROM {table}_e)"""


_AFTER = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
ORACLE = {
    "op10_url_filters": f"""
WITH p AS (SELECT page_id, {_AFTER} AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT host, (quality = 0 OR toxic = 1)::INT AS bad FROM q JOIN labels ON page_id = doc_id),
u AS (SELECT host, bad FROM o UNION ALL SELECT DISTINCT host, NULL FROM q),
l2 AS (SELECT host, bad, array_to_string(split(host, '.')[-2:], '.') AS two FROM u),
l3 AS (SELECT host, bad, two, two IN ({", ".join(f"'{x}'" for x in TWO_LABELS)}) AND two <> host AS long FROM l2),
h AS (SELECT host, CASE WHEN long THEN array_to_string(split(host, '.')[-3:], '.') ELSE two END AS domain, CASE WHEN long THEN two ELSE split(host, '.')[-1] END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM l3 GROUP BY ALL),
d0 AS (SELECT domain, suffix, sum(n) AS dn, sum(x) AS dx FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(dn) AS sn, sum(dx) AS sx FROM d0 GROUP BY suffix),
g AS (SELECT (sum(sx) + 1.0::DOUBLE) / (sum(sn) + 2.0::DOUBLE) AS base FROM s0),
s1 AS (SELECT s0.*, base, sx::DOUBLE AS gx, sn::DOUBLE AS gn, base AS centre FROM s0, g), {_strength("s1", "ks")},
d1 AS (SELECT d0.*, sn, sx, base, (sx + ks * base) / (sn + ks) AS centre, dx::DOUBLE AS gx, dn::DOUBLE AS gn, sn - dn + ks AS others, ks FROM d0 JOIN s1 USING (suffix), s1_k), {_strength("d1", "kd")},
d2 AS (SELECT *, 1 / (1 / kd + 1 / others) AS dk, (sx - dx + ks * base) / others AS dp FROM d1, d1_k),
h1 AS (SELECT host, n, x, dn, dx, dk, dp, x::DOUBLE AS gx, n::DOUBLE AS gn, (dx + dk * dp) / (dn + dk) AS centre, dn - n + dk AS others FROM h JOIN d2 USING (domain)), {_strength("h1", "kh")},
h2 AS (SELECT *, 1 / (1 / kh + 1 / others) AS k, (dx - x + dk * dp) / others AS p FROM h1, h1_k),
h3 AS (SELECT host, greatest(x + k * p, 1) AS a, greatest(n - x + k * (1 - p), 1) AS b FROM h2),
h4 AS (SELECT host, a, b, 1 / (2 * a - 1) AS ip, 1 / (2 * b - 1) AS iq FROM h3),
h5 AS (SELECT host, a, b, ip, iq, 2 / (ip + iq) AS hm, ({DEVIATE}::DOUBLE * {DEVIATE}::DOUBLE - 3) / 6 AS lam FROM h4),
b AS (SELECT host, a / (a + b * exp(2 * ({DEVIATE}::DOUBLE * sqrt(hm + lam) / hm - (iq - ip) * (lam + 5.0::DOUBLE / 6 - 2 / (3 * hm))))) AS bound FROM h5),
rules(what, rule, rhost, rpath) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what FROM q, rules
      WHERE (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath) GROUP BY page_id)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.what, CASE WHEN b.bound > {LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN b ON b.host = q.host LEFT JOIN m ON m.page_id = q.page_id
"""
}
QUERIES = {"op10_url_filters": op10_url_filters}
