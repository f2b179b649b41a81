"""URL filters by a path-template tree, in DataFrame functions only.

Rules: the longest rule that fits a url decides. Other urls are judged by their template. Per host, a tree
is grown from the root, level by level. A url goes down by its path segments; at each node (host and the
branches so far) a segment gets a branch of its own if it holds no digit and at least one in ``SHARE`` of
the node's urls has it, all others are generalised into the wildcard ``?``. Branches of one node whose
share of blocked labels is statistically alike (or which have too few labels to tell) are merged into one
branch ``#``, and so are the trees below them. (Neither sign can be part of a path.) A template is a path
from the root; it is rejected if its smoothed purity, the share of blocked among its urls that a rule
decides, drawn towards its host's, exceeds ``REJECT``.

Urls are first counted by host and path. Counts and sums are partial aggregates, and of a node's segments
at most ``SHARE`` leave a task, so a host with a third of all urls costs a few rows per task; its urls meet
their branches in many dealings, and the templates by host and path. The tree is as deep as the deepest path: each
level looks at the paths that go on there only.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged by the
template of those; repeated rows are each judged; extra columns pass through (but for those named as the
results, in any case); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment is a branch if one in SHARE urls has it.
SHARE = 20
#: Labels that a branch needs before it can differ from its siblings.
LEAST = 5
REJECT = 0.75
#: Parts that the urls of a node are dealt in; levels after which finished paths are written; levels that the SQL twin spells out.
DEALINGS, LEVELS, TWIN_LEVELS = 32, 8, 8

#: (verdict, host, path): the rule fits the host and its subdomains, and paths that start with the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def key_of(path: Column) -> Column:
    """The segments that are not empty, joined by /."""
    return F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")


def alike(a: str, b: str, pool_a: str, pool_b: str, least: int) -> Column:
    """Whether b blocked of a labelled lie within two standard errors of what the pool would give, or are too few."""
    a, b, pa, pb = (F.col(x).cast("double") for x in (a, b, pool_a, pool_b))
    gap = b * pa - pb * a
    return (a < least) | (gap * gap <= 4 * a * pb * (pa - pb))


def dealing_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DEALINGS))


def every_dealing() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALINGS - 1).cast("long"))).alias("dealing")


def level(paths: DataFrame, depth: int, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Paths with their template grown by one level."""
    node = ["host", "template"]
    paths = paths.withColumn("segment", F.try_element_at(F.split("key", "/"), F.lit(depth + 1))).withColumn("segment", F.when(F.col("segment") != "", F.col("segment")))
    counts = paths.where("segment IS NOT NULL").groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    total = counts.groupBy(*node).agg(F.sum("n").alias("total"))
    # At most ``share`` segments can have their share; a task sends no more per node.
    most = counts.where(~F.col("segment").rlike("[0-9]")).withColumn("place", F.row_number().over(Window.partitionBy(*node).orderBy(F.desc("n"), "segment"))).where(F.col("place") <= share).drop("place")
    kept = most.join(total, node).where(F.col("n") * share >= F.col("total"))
    pool = kept.groupBy(*node).agg(F.sum("labelled").alias("pool_labelled"), F.sum("blocked").alias("pool_blocked"), F.count("*").alias("branches"))
    named = kept.join(pool, node).withColumn("branch", F.when((F.col("branches") > 1) & alike("labelled", "blocked", "pool_labelled", "pool_blocked", least), "#").otherwise(F.col("segment")))
    # A node's few branches go to each of its dealings, so that no task gets all urls of a host.
    branches = named.select(*node, "segment", "branch", every_dealing())
    down = F.coalesce("branch", F.lit("?"))
    grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), down))
    return paths.withColumn("dealing", dealing_of("key")).join(branches, [*node, "segment", "dealing"], "left").withColumn("template", grown).drop("branch", "segment", "dealing")


def verdicts(paths: DataFrame, reject: float = REJECT) -> DataFrame:
    """host, key, template, rejected of the paths, by the purity of their templates."""
    paths = paths.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template")))
    hosts = paths.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    templates = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    prior = (F.col("host_blocked") + 1).cast("double") / (F.col("host_labelled") + 2)
    purity = (F.col("blocked") + 2 * prior) / (F.col("labelled") + 2)
    judged = templates.join(hosts, "host").select("host", "template", (purity > reject).alias("rejected"), every_dealing())
    return paths.select("host", "key", "template", dealing_of("key").alias("dealing")).join(judged, ["host", "template", "dealing"]).drop("dealing")


def judge(pages: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """All columns of ``pages`` with host, path, template, rule and verdict."""
    own = C.others(pages.columns, "host", "path", "template", "rule", "verdict")
    read = pages.select(F.struct(*own).alias("page"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    read = read.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("key", key_of(F.col("path")))
    paths = read.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("found").alias("labelled"), F.count_if(F.col("found.verdict") == "block").alias("blocked"))
    size = F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", "/")))
    going = C.written(paths.withColumn("template", F.lit("")), "url-paths")
    done, deepest = going.where(size == 0), going.agg(F.max(size)).first()[0] or 0
    for depth in range(deepest):
        going = C.written(level(going.where(size > depth), depth), "url-paths")
        done = done.unionByName(going.where(size == depth + 1))
        if depth % LEVELS == LEVELS - 1:  # a plan of few parts, however deep the tree
            done = C.written(done, "url-paths")
    paths = done
    judged = read.join(verdicts(paths, reject), ["host", "key"])
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return judged.select("page.*", "host", "path", "template", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def oracle() -> str:
    """The query in SQL, with the rules above."""
    parts = ["""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS MATERIALIZED (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segments
  FROM parts
), tree0 AS MATERIALIZED (
  SELECT host, segments, count(*) AS n, count(rule)::BIGINT AS a, count_if(coalesce(rule, '') IN ('net/', 'example.com/de/'))::BIGINT AS b, '' AS template FROM ruled GROUP BY ALL
)"""]
    for d in range(1, TWIN_LEVELS + 1):
        parts.append(f"""counts{d} AS MATERIALIZED (
  SELECT host, template, segments[{d}] AS segment, sum(n) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM tree{d - 1} WHERE len(segments) >= {d} GROUP BY ALL
), kept{d} AS (
  SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM counts{d}) WHERE NOT regexp_matches(segment, '[0-9]') AND n * {SHARE} >= total
), pooled{d} AS (
  SELECT *, count(*) OVER (PARTITION BY host, template) AS k, a::DOUBLE AS x, b::DOUBLE AS y,
    (sum(a) OVER (PARTITION BY host, template))::DOUBLE AS px, (sum(b) OVER (PARTITION BY host, template))::DOUBLE AS py FROM kept{d}
), named{d} AS MATERIALIZED (
  SELECT host, template, segment, CASE WHEN k > 1 AND (x < {LEAST} OR (y * px - py * x) * (y * px - py * x) <= 4 * x * py * (px - py)) THEN '#' ELSE segment END AS branch FROM pooled{d}
), tree{d} AS MATERIALIZED (
  SELECT t.host, t.segments, t.n, t.a, t.b, CASE WHEN len(t.segments) >= {d} THEN t.template || '/' || coalesce(b.branch, '?') ELSE t.template END AS template
  FROM tree{d - 1} t LEFT JOIN named{d} b ON t.host = b.host AND t.template = b.template AND t.segments[{d}] = b.segment
)""")
    parts.append(f"""leaves AS MATERIALIZED (
  SELECT host, segments, a, b, CASE WHEN template = '' THEN '/' ELSE template END AS template FROM tree{TWIN_LEVELS}
), purity AS (
  SELECT host, template, (sum(b) + 2 * ((h + 1)::DOUBLE / (g + 2))) / (sum(a) + 2) > {REJECT} AS rejected
  FROM (SELECT *, sum(a) OVER (PARTITION BY host) AS g, sum(b) OVER (PARTITION BY host) AS h FROM leaves) GROUP BY host, template, g, h
), judged AS (
  SELECT l.host, l.segments, p.rejected FROM leaves l JOIN purity p ON l.host = p.host AND l.template = p.template
)
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow' WHEN j.rejected THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r JOIN judged j ON r.host = j.host AND r.segments = j.segments
""")
    return ", ".join(parts)


ORACLE = oracle()
