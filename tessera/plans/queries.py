"""The engine's registered queries over the given tables, each with its SQL twin.

Tables stand in for the directory's records: pages for raw pages, events for item streams, documents
for names and texts, labels for states, customers with orders and line items for analytics rows, parts
for skills. Numbers are cast and sums are of decimals, so that both engines give the same values.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import combos, text, values
from ..operators import leaderboard, metrics, ordered, quality, records, search
from ..sources import files, pages
from ..streaming import streams
from .engine import Config, Engine, pages_by_url
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .registry import table as _t

def _long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _money(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def _links(spark, sf_dir) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))
    return rows.select("page_id", _long("pos").alias("pos"), text.absolute_url(F.col("href"), "https://directory.example").alias("link"))


_LINKS = """links AS (SELECT page_id, pos - 1 AS pos, CASE WHEN starts_with(trim(href), 'http') THEN trim(href) ELSE 'https://directory.example' || trim(href) END AS link FROM (
  SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)))"""


# ---------------------------------------------------------------- pages

@query(f"WITH {_LINKS}, firsts AS (SELECT link, min(page_id * 1000000 + pos) AS k FROM links GROUP BY link) SELECT k // 1000000 AS page_id, count(*) AS n FROM firsts GROUP BY 1 ORDER BY n DESC, page_id LIMIT 20")
def page_links_dedup(spark, sf_dir):
    """Links of all pages, the first of each kept, counted by page; the best 20 pages."""
    links = _links(spark, sf_dir).withColumn("seq", F.struct("page_id", "pos"))
    first = records.first_per_key(links, "link", "seq")
    return first.groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_id").limit(20)


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"SELECT host, page_id, url FROM (SELECT {_HOST} AS host, page_id, url, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def page_first_wins_host(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", "url")
    return records.first_per_key(rows, "host", "page_id")


@query("""SELECT page_id, (s1 + s2 + s3)::BIGINT AS score, CASE WHEN blocked THEN 'blocked' ELSE 'ok' END AS status FROM (
  SELECT page_id, (length(html) >= 4000)::INT AS s1, contains(html, '<h1')::INT AS s2, contains(html, '<table')::INT AS s3, contains(lower(html), 'cloudflare') AS blocked FROM pages) WHERE s1 + s2 + s3 >= 2""")
def page_conf_score(spark, sf_dir):
    signal = lambda c: c.cast("int")
    score = signal(F.length("html") >= 4000) + signal(F.contains("html", F.lit("<h1"))) + signal(F.contains("html", F.lit("<table")))
    rows = _t(spark, sf_dir, "pages").select("page_id", _long(score).alias("score"), F.when(F.contains(F.lower("html"), F.lit("cloudflare")), "blocked").otherwise("ok").alias("status"))
    return rows.where("score >= 2")


@query("SELECT sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages")
def page_octets(spark, sf_dir):
    return metrics.bytes_downloaded(_t(spark, sf_dir, "pages"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)', 1)), '') AS title FROM pages")
def page_title_extract(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1)), F.lit("")).alias("title"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS short_url, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS slug FROM pages")
def url_slug_host(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.without_scheme(F.col("url")).alias("short_url"), text.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, sha256(html) AS sha FROM pages")
def content_sha(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("url")).alias("escaped"))


# ---------------------------------------------------------------- joins, upserts, generators

@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.remaining(_t(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def suppression_anti(spark, sf_dir):
    known = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return records.suppressed(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), known, "c_custkey")[0]


@query("SELECT count(*) AS suppressed FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def suppression_count(spark, sf_dir):
    known = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.suppressed(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), known, "c_custkey")[1]


@query("SELECT n_name AS label, r_name AS combo, n_nationkey AS last_page FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 0")
def cache_inner_join(spark, sf_dir):
    cache = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("label"), F.col("n_nationkey").alias("last_page"))
    jobs = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("combo"))
    return records.cached_jobs(cache, jobs).select(F.col("name").alias("label"), "combo", "last_page")


@query("""WITH base AS (SELECT c_custkey::VARCHAR AS profile_url, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END AS rank FROM customer),
fix AS (SELECT o_custkey::VARCHAR AS url, min(o_orderpriority) AS title, count(*) AS rating FROM orders GROUP BY 1)
SELECT profile_url, coalesce(nullif(f.title, ''), b.title) AS title, coalesce(f.rating::VARCHAR, rank) AS rank FROM base b LEFT JOIN fix f ON url = profile_url""")
def upsert_fixup(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("profile_url"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("rank"))
    parsed = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("profile_url")).agg(F.min("o_orderpriority").alias("title"), F.count("*").alias("rating"))
    return records.fix_up(base, parsed)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def needs_fixup(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("title"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("rank"))
    return records.needs_fixup(rows).select("c_custkey", "c_name")


@query("SELECT p_partkey, unnest(generate_series(1, p_size)) AS page FROM part WHERE p_size >= 1")
def page_expand(spark, sf_dir):
    return records.pages_of(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", _long("page").alias("page"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS position FROM events GROUP BY user_id")
def last_wins_dedup(spark, sf_dir):
    return records.last_per_key(_t(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_wins_dedup(spark, sf_dir):
    return records.first_per_key(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH u AS (SELECT c_nationkey AS k, c_custkey AS seq, 0 AS part FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier)
SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, seq) AS n FROM u) WHERE n = 1""")
def union_first_wins(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("seq"))
    new = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("seq"))
    return records.union_first(old, new, "k", "seq")


@query("SELECT DISTINCT nullif(regexp_split_to_array(trim(text), '\\s+')[1], '') AS keyword FROM documents WHERE trim(text) <> ''")
def first_words(spark, sf_dir):
    return records.distinct_first_words(_t(spark, sf_dir, "documents"), "text")


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels), p AS (SELECT doc_id, (doc_id % 7)::INT AS quality, 0 AS toxic FROM documents),
j AS (SELECT coalesce(l.doc_id, p.doc_id) AS doc_id, l.doc_id IS NULL AS nl, p.doc_id IS NULL AS np, l.quality AS lq, p.quality AS pq, l.toxic AS lt, p.toxic AS pt FROM l FULL JOIN p ON l.doc_id = p.doc_id),
c AS (SELECT *, 'quality' AS field, lq::VARCHAR AS stored, pq::VARCHAR AS parsed FROM j UNION ALL SELECT *, 'toxic', lt::VARCHAR, pt::VARCHAR FROM j)
SELECT doc_id, field, CASE WHEN nl THEN 'only_parsed' WHEN np THEN 'only_stored' WHEN stored IS NULL THEN 'filled' WHEN parsed IS NULL THEN 'lost' ELSE 'changed' END AS kind, stored, parsed FROM c WHERE stored IS DISTINCT FROM parsed""")
def compare_records(spark, sf_dir):
    stored = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    parsed = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("quality"), F.lit(0).alias("toxic"))
    return records.compared(stored, parsed, "doc_id", ["quality", "toxic"])


@query("""WITH stored AS (SELECT DISTINCT ON (url) url || '/portfolio' AS url, html FROM pages WHERE contains(url, '://www.') ORDER BY url, page_id)
SELECT l.page_id, l.url, coalesce(length(p.html), 0)::BIGINT AS portfolio_chars FROM pages l LEFT JOIN stored p ON p.url = l.url || '/portfolio'""")
def portfolio_pairing(spark, sf_dir):
    """Pages of www hosts stand for portfolio pages of the same address."""
    stored = _t(spark, sf_dir, "pages")
    other = records.first_per_key(stored.where("contains(url, '://www.')").select("page_id", F.concat("url", F.lit("/portfolio")).alias("url"), "html"), "url", "page_id")
    rows = records.with_portfolio(stored.select("page_id", F.col("url").alias("profile_url")), other.select("url", "html"))
    return rows.select("page_id", F.col("profile_url").alias("url"), F.coalesce(F.char_length("portfolio_html"), F.lit(0)).cast("long").alias("portfolio_chars"))


# ---------------------------------------------------------------- leaderboard

def _analytics(spark, sf_dir) -> DataFrame:
    """Customers as analytics rows: score from the balance, completion from the share of finished orders."""
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("projects"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    rows = _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return rows.select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("u/"), F.col("c_custkey").cast("string")).alias("profile_url"), (F.col("c_acctbal") / 100).alias("success_score"),
        F.coalesce(F.col("done") * 100 / F.col("projects"), F.lit(0.0)).alias("completion_rate"), F.coalesce("projects", F.lit(0)).alias("projects"))


_ANALYTICS = """a AS (SELECT c_custkey, c_name AS name, c_mktsegment AS title, 'u/' || c_custkey AS profile_url, c_acctbal / 100 AS success_score,
  coalesce(done * 100.0::DOUBLE / projects, 0.0::DOUBLE) AS completion_rate, coalesce(projects, 0) AS projects FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS projects, count_if(o_orderstatus = 'F')::BIGINT AS done FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query(f"""WITH {_ANALYTICS} SELECT row_number() OVER (ORDER BY success_score DESC, profile_url) AS rank, profile_url,
  CASE WHEN success_score >= 80 THEN 'high' WHEN success_score >= 60 THEN 'middle' WHEN success_score < 40 THEN 'low' END AS score_band,
  CASE WHEN completion_rate >= 95 THEN 'high' WHEN completion_rate < 70 THEN 'low' END AS completion_band FROM a""")
def leaderboard_rank(spark, sf_dir):
    rows = leaderboard.ranked(_analytics(spark, sf_dir))
    return rows.select(_long("rank").alias("rank"), "profile_url", leaderboard.score_band(F.col("success_score")).alias("score_band"), leaderboard.completion_band(F.col("completion_rate")).alias("completion_band"))


@query(f"WITH {_ANALYTICS} SELECT coalesce(name, profile_url) AS label, success_score FROM a ORDER BY success_score DESC, profile_url LIMIT 20")
def top20_grouped(spark, sf_dir):
    return leaderboard.display_name(leaderboard.top(_analytics(spark, sf_dir), 20, "success_score", "profile_url")).select("label", "success_score")


@query(f"WITH {_ANALYTICS} SELECT max(success_score) AS best_score, round(avg(completion_rate), 6) AS mean_completion, count(*) AS n_rows FROM a")
def kpi_cards(spark, sf_dir):
    return leaderboard.key_figures(_analytics(spark, sf_dir)).withColumn("mean_completion", F.round("mean_completion", 6))


def _skills(spark, sf_dir) -> DataFrame:
    """Parts' types as lists of skills."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("skills"), F.col("p_size").cast("double").alias("completion_rate"), F.col("p_retailprice").alias("success_score"))
    return leaderboard.exploded(rows, "p_partkey")


_SKILLS = "s AS (SELECT p_partkey, unnest(k) AS skill, generate_subscripts(k, 1) AS pos, p_size, p_retailprice FROM (SELECT *, string_split(p_type, ' ') AS k FROM part))"
_COUNTED = "f AS (SELECT skill, count(*) AS n, min(p_partkey * 1000 + pos) AS met FROM s GROUP BY skill)"


@query(f"WITH {_SKILLS}, {_COUNTED} SELECT skill, n FROM f ORDER BY n DESC, met LIMIT 25")
def skill_frequency(spark, sf_dir):
    return leaderboard.frequent(_skills(spark, sf_dir), 25)


@query(f"WITH {_SKILLS}, {_COUNTED} SELECT skill FROM f ORDER BY n DESC, met LIMIT 1")
def kpi_top_skill(spark, sf_dir):
    return leaderboard.frequent(_skills(spark, sf_dir), 1).select("skill")


@query(f"""WITH {_SKILLS}, {_COUNTED}, t AS (SELECT skill FROM f ORDER BY n DESC, met LIMIT 20)
SELECT skill, round(sum(p_size)::DOUBLE / count(*), 4) AS mean_completion, round(sum(p_retailprice::DECIMAL(18,2))::DOUBLE / count(*), 3) AS mean_score, count(*) AS n FROM s WHERE skill IN (SELECT skill FROM t) GROUP BY skill""")
def skill_completion(spark, sf_dir):
    rates = leaderboard.skill_rates(_skills(spark, sf_dir).withColumn("success_score", _money("success_score")))
    return rates.select("skill", F.round("mean_completion", 4).alias("mean_completion"), F.round("mean_score", 3).alias("mean_score"), "n")


@query("""WITH v AS (SELECT value::DOUBLE AS x FROM events WHERE value > 0), e AS (SELECT min(x) AS low, max(x) AS high FROM v)
SELECT CASE WHEN high > low THEN least(floor((x - low) / ((high - low) / 30)), 29) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def histogram_bins(spark, sf_dir):
    return leaderboard.histogram(_t(spark, sf_dir, "events"), "value", 30)


@query("""SELECT min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high, round(avg(value), 4) AS mean, round(stddev(value), 4) AS deviation FROM events""")
def score_quartiles(spark, sf_dir):
    return leaderboard.distribution(_t(spark, sf_dir, "events"), "value").withColumns({"mean": F.round("mean", 4), "deviation": F.round("deviation", 4)})


@query(f"WITH {_ANALYTICS} SELECT profile_url, round(sqrt(greatest(projects::DOUBLE, 1.0)) * 4, 6) AS bubble FROM a")
def bubble_scatter(spark, sf_dir):
    return leaderboard.bubbles(_analytics(spark, sf_dir), "projects").select("profile_url", F.round("bubble", 6).alias("bubble"))


_KEYS = ("page", "amount", "k", "v", "n")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, coalesce(try_cast(event_type AS DOUBLE), 0) AS kind, coalesce(try_cast(value::VARCHAR AS DOUBLE), 0) AS value FROM events")
def coerce_numeric(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"), F.col("value").cast("string").alias("value"))
    return rows.select("event_id", *[values.number_or_zero(F.col(c)).alias(c) for c in ("k", "kind", "value")])


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN len(string_split(p_type, ' ')) ELSE 0 END::INT AS n, CASE p_partkey % 4 WHEN 0 THEN string_split(p_type, ' ')[1] END AS head FROM part""")
def skills_repair(spark, sf_dir):
    """Parts' types as JSON lists, plain texts, nulls and empty lists."""
    words = F.to_json(F.split("p_type", " "))
    skills = F.when(F.col("p_partkey") % 4 == 0, words).when(F.col("p_partkey") % 4 == 1, F.col("p_type")).when(F.col("p_partkey") % 4 == 2, F.lit("[]"))
    out = leaderboard.typed(_t(spark, sf_dir, "part").select("p_partkey", skills.alias("skills")))
    return out.select("p_partkey", F.size("skills").alias("n"), F.get("skills", F.lit(0)).alias("head"))


@query("SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def category_stats(spark, sf_dir):
    return leaderboard.categories(_t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category")))


@query(f"WITH {_ANALYTICS} SELECT profile_url, success_score, completion_rate FROM a WHERE success_score > 50 ORDER BY completion_rate DESC, success_score DESC, profile_url OFFSET 20 LIMIT 20")
def grid_page(spark, sf_dir):
    rows = _analytics(spark, sf_dir).where("success_score > 50")
    return leaderboard.existing(records.paged(rows, 1, 20, F.desc("completion_rate"), F.desc("success_score"), "profile_url"), ("profile_url", "success_score", "completion_rate", "absent"))


# ---------------------------------------------------------------- quality and metrics

def _labelled(spark, sf_dir) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(F.col("source"), F.lit("src0")).alias("name"))
    confidence = F.when(F.col("quality") == 0, "blocked").when(F.col("toxic") == 1, "no_html")
    return docs.join(labels, "doc_id", "left").withColumn("status", quality.status(confidence, F.col("name")))


_LABELLED = """r AS (SELECT d.doc_id, lang, nullif(source, 'src0') AS name, quality, toxic, CASE WHEN quality = 0 THEN 'blocked' WHEN toxic = 1 THEN 'fetch_failed' WHEN nullif(source, 'src0') IS NULL THEN 'parse_miss' ELSE 'ok' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"WITH {_LABELLED} SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 4) AS percent FROM r GROUP BY status")
def status_breakdown(spark, sf_dir):
    return quality.status_breakdown(_labelled(spark, sf_dir)).withColumn("percent", F.round("percent", 4))


@query(f"""WITH {_LABELLED}, c AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'ok', * FROM r WHERE status = 'ok'),
u AS (SELECT scope, 'lang' AS field, lang IS NULL AS gone FROM c UNION ALL SELECT scope, 'name', name IS NULL FROM c UNION ALL SELECT scope, 'quality', quality IS NULL FROM c UNION ALL SELECT scope, 'toxic', toxic IS NULL FROM c)
SELECT scope, field, count_if(gone)::BIGINT AS nulls, count(*) AS rows, round(100.0 * count_if(gone) / count(*), 4) AS percent FROM u GROUP BY ALL""")
def null_profile(spark, sf_dir):
    return quality.null_profile(_labelled(spark, sf_dir), ("lang", "name", "quality", "toxic")).withColumn("percent", F.round("percent", 4))


@query(f"WITH {_LABELLED} SELECT doc_id, ((coalesce(lang, '') = '')::INT + (coalesce(name, '') = '')::INT + (coalesce(quality, 0) = 0)::INT + (coalesce(toxic, 0) = 0)::INT)::BIGINT AS missing FROM r")
def missing_fields(spark, sf_dir):
    rows = quality.missing_fields(_labelled(spark, sf_dir), ("lang", "name", "quality", "toxic"), ())
    return rows.select("doc_id", _long("missing").alias("missing"))


@query("SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n FROM part GROUP BY 1")
def issue_kinds(spark, sf_dir):
    return quality.issue_kinds(_t(spark, sf_dir, "part").select(F.regexp_replace("p_type", " ", ":").alias("issue")))


def _metric_rows(spark, sf_dir) -> DataFrame:
    events = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    cells = F.array(F.struct(F.lit("items").alias("metric"), F.col("n").cast("double").alias("value"), F.lit(True).alias("overlappable")), F.struct(F.lit("users").alias("metric"), F.col("users").cast("double").alias("value"), F.lit(False).alias("overlappable")))
    return events.select("phase", F.explode(cells).alias("c")).select("phase", "c.*")


@query("SELECT 'items' AS metric, count(*)::DOUBLE AS total, count(DISTINCT event_type) AS phases FROM events")
def phase_metrics_agg(spark, sf_dir):
    return metrics.totals(_metric_rows(spark, sf_dir))


@query("SELECT 'users' AS metric, event_type AS phase, count(DISTINCT user_id)::DOUBLE AS value FROM events GROUP BY event_type")
def phase_metrics_rest(spark, sf_dir):
    return metrics.per_phase(_metric_rows(spark, sf_dir)).select("metric", F.explode("by_phase").alias("phase", "value"))


@query("""SELECT event_type, n, seconds, CASE WHEN seconds > 0 THEN round(n / seconds, 6) ELSE 0 END AS per_second FROM (
  SELECT event_type, count(*) AS n, (epoch(max(ts)) - epoch(min(ts)))::BIGINT::DOUBLE AS seconds FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY 1)""")
def throughput(spark, sf_dir):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).cast("double").alias("seconds"))
    return rows.withColumn("per_second", F.round(metrics.rate(F.col("n"), F.col("seconds")), 6))


@query("SELECT event_type AS phase, count(*) AS n, count_if(value > 10)::BIGINT AS succeeded, count(*) - count_if(value > 10)::BIGINT AS failed FROM events GROUP BY 1")
def outcome_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.when(F.col("value") > 10, "x").otherwise("Unknown").alias("name"))
    return metrics.outcome_counts(rows, "phase")


@query("SELECT url, (SELECT greatest(count(*) - 20, 0) FROM pages WHERE html IS NULL OR NOT contains(lower(html), '</html>')) AS more FROM pages WHERE html IS NULL OR NOT contains(lower(html), '</html>') ORDER BY url LIMIT 20")
def failed_urls(spark, sf_dir):
    """Of all pages, those that are missing or end before their end tag."""
    return metrics.failed_urls(_t(spark, sf_dir, "pages").where("html IS NULL OR NOT contains(lower(html), '</html>')"), "url")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def recent_n(spark, sf_dir):
    return records.recent(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 2, "turn", "conv_id")


@query("""WITH u AS (SELECT c_nationkey AS path, 0 AS priority FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier UNION ALL SELECT n_nationkey, 2 FROM nation)
SELECT path, min(priority) AS priority FROM u GROUP BY path""")
def priority_union(spark, sf_dir):
    columns = (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))
    return records.by_priority([_t(spark, sf_dir, name).select(F.col(key).alias("path")) for name, key in columns], "path")


# ---------------------------------------------------------------- functions on given texts

@query("SELECT c_custkey, 'اكمال ' || c_name || ' المشاريع' AS label FROM customer")
def arabic_normalize(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    return rows.select("c_custkey", text.normalize_label(F.concat(F.lit(" إكمال  "), "c_name", F.lit("\u00a0المشـاريع\t"))).alias("label"))


@query("SELECT c_custkey, 'محمد علي ' || lower(c_name) || ' فاطمه' AS name FROM customer")
def search_normalize(spark, sf_dir):
    name = F.concat(F.lit("مُحَمَّد على "), "c_name", F.lit(" فاطمة"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.normalize_search(name).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, l_discount::DECIMAL(18,4)::DOUBLE AS percent, l_extendedprice::DECIMAL(18,2)::DOUBLE AS money, l_quantity::BIGINT AS projects FROM lineitem""")
def percent_parse(spark, sf_dir):
    """Discounts, prices and quantities of line items, written as the pages write them and read again."""
    percent = F.concat(F.translate(F.col("l_discount").cast("decimal(18,4)").cast("string"), values.WESTERN_DIGITS, values.EASTERN_DIGITS), F.lit("%"))
    money = F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))
    projects = F.concat(_long("l_quantity").cast("string"), F.lit(" مشروع"))
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", values.decimal_of(percent).alias("percent"), values.decimal_of(money).alias("money"), values.integer_of(projects).alias("projects"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 120 WHEN 2 THEN 60 * (p_size % 7 + 1) + p_size WHEN 3 THEN p_size ELSE 0 END::BIGINT AS minutes FROM part")
def duration_minutes(spark, sf_dir):
    """Sizes of parts as durations, in the forms that the pages have."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    eastern = F.translate(size, values.WESTERN_DIGITS, values.EASTERN_DIGITS)
    long = F.concat((F.col("p_size") % 7 + 1).cast("string"), F.lit(" ساعات و "), size, F.lit(" دقيقة"))
    told = F.when(kind == 0, "أقل من دقيقة").when(kind == 1, "ساعتين").when(kind == 2, long).when(kind == 3, F.concat(eastern, F.lit(" دقائق")))
    return _t(spark, sf_dir, "part").select("p_partkey", values.minutes_of(told).alias("minutes"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN make_date(2000 + o_orderkey % 100, 1, 1) ELSE o_orderdate::DATE END::VARCHAR AS day FROM orders")
def date_parse(spark, sf_dir):
    """Dates of orders in Arabic, in figures, and as a year alone."""
    months = F.create_map(*[x for k, name in {k: name for name, k in values.MONTHS.items()}.items() for x in (F.lit(k), F.lit(name))])
    arabic = F.concat_ws(" ", F.dayofmonth("o_orderdate"), F.try_element_at(months, F.month("o_orderdate")), F.year("o_orderdate"))
    kind = F.col("o_orderkey") % 3
    year = F.concat(F.lit("منذ "), (F.col("o_orderkey") % 100 + 2000).cast("string"))
    told = F.when(kind == 0, arabic).when(kind == 1, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(year)
    return _t(spark, sf_dir, "orders").select("o_orderkey", values.date_of(told).cast("string").alias("day"))


@query("""SELECT c_custkey, upper(CASE WHEN len(w) = 1 THEN w[1][1] ELSE w[1][1] || w[-1][1] END) AS initials, nullif(w[1], '') AS first_word FROM (
  SELECT c_custkey, regexp_split_to_array(trim(replace(c_name, '#', ' ')), '\\s+') AS w FROM customer)""")
def name_parts(spark, sf_dir):
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.initials(name).alias("initials"), text.first_word(name).alias("first_word"))


@query("SELECT page_id, 'https:' || regexp_replace(url, '^https?:', '') AS avatar, printf('%02d:%02d', page_id // 60, page_id % 60) AS clock, printf('%.1f', page_id / 5.0::DOUBLE) AS rounded FROM pages")
def formats(spark, sf_dir):
    """Addresses without a scheme, and numbers of pages as seconds and fifths."""
    avatar = F.concat(F.lit(" "), F.regexp_replace("url", "^https?:", ""))
    return _t(spark, sf_dir, "pages").select("page_id", text.avatar_url(avatar).alias("avatar"), text.minutes_seconds(F.col("page_id") + 0.9).alias("clock"), text.one_decimal(F.col("page_id") / 5).alias("rounded"))


@query("""SELECT n_nationkey, 'development+country=' || n_name AS label, 'https://d/l?verified=false&specialities=development&country=' || replace(n_name, ' ', '+') || '&keyword=' || lower(replace(r_name, ' ', '+')) || '%26~%2A' || CASE WHEN n_nationkey > 0 THEN '&page=' || (n_nationkey + 1) ELSE '' END AS url
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def combo_url(spark, sf_dir):
    """Labels and addresses of nations as countries, with the region as keyword."""
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    word = F.concat(F.lower("r_name"), F.lit("&~*"))
    return rows.select("n_nationkey", combos.label(F.lit("country"), F.col("n_name")).alias("label"), combos.listing_url("https://d/l", F.lit("country"), F.col("n_name"), word, F.col("n_nationkey") + 1).alias("url"))


@query("""SELECT dim, n_nationkey, k::BIGINT AS pages FROM nation, (VALUES ('base', 1), ('rating', 5), ('titles', 20), ('skills', 56), ('country', 254)) t(dim, k)""")
def combos_all(spark, sf_dir):
    """All combinations of the search, for every nation's directory, counted by dimension."""
    jobs = _t(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(combos.combinations(spark)))  # 336 rows
    return jobs.groupBy("dim", "n_nationkey").agg(F.count("*").alias("pages"))


# ---------------------------------------------------------------- search

@query("SELECT doc_id, 1000 - (instr(lower(text), 'ation') - 1)::BIGINT AS score FROM documents WHERE instr(lower(text), 'ation') > 0")
def search_literal(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("norm"))
    return search.search(rows, "ation", order="doc_id", exact=True).select("doc_id", _long("score").alias("score"))


@query("""WITH g AS (SELECT c_custkey, lower(c_mktsegment) || ' ' || lower(c_name) AS norm FROM customer),
f AS (SELECT c_custkey, regexp_extract(norm, '^[^u]*(u[^o]*o[^0]*0[^7]*7)', 1) AS hit, instr(norm, 'uo07') AS place FROM g)
SELECT c_custkey, CASE WHEN place > 0 THEN 1000 - (place - 1) ELSE 40 - (length(hit) - 4) END::BIGINT AS score FROM f WHERE place > 0 OR hit <> ''""")
def search_fuzzy(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("c_name")).alias("norm"))
    return search.search(rows, "uo07", order="c_custkey").select("c_custkey", _long("score").alias("score"))


@query("""SELECT c_custkey, 'MER' AS q, regexp_replace(c_name, '(?i)^(.*?)(mer)', '\\1<mark>\\2</mark>') AS marked FROM (SELECT c_custkey, 'a ' || c_name AS c_name FROM customer)
UNION ALL SELECT c_custkey, 'شرك', '<mark class="ctx">ال</mark><mark>شرك</mark><mark class="ctx">ة</mark> ' || c_name FROM customer
UNION ALL SELECT c_custkey, 'b', 'a &lt;<mark>b</mark> ' || c_name FROM customer""")
def search_highlight(spark, sf_dir):
    """Hits in the names of all customers: as they stand, with Arabic affixes around them, and beside a character that HTML escapes."""
    found = None
    for q, lead, exact in (("MER", "a ", True), ("شرك", "الشركة ", False), ("b", "a <b ", False)):
        rows = _t(spark, sf_dir, "customer").select("c_custkey", F.lit(q).alias("q"), F.concat(F.lit(lead), "c_name").alias("c_name"))
        hits = search.highlights(rows, "c_name", q, exact=exact).select("c_custkey", "q", "marked")
        found = hits if found is None else found.unionByName(hits)
    return found


# ---------------------------------------------------------------- directory pages

LISTING_PAGE = """<table><tr class="freelancer-row"><td class="details-td"><a href="/u/ada"><bdi>Ada L</bdi></a></td><td class="info-td"><img src="//img/ada.png"><p><i class="fa fa-briefcase"></i> Engineer</p>
<span class="freelancers__item-rating"><i class="fa-star"></i><i class="fa-star"></i><i class="fa-star"></i><i class="fa-star-half-o"></i></span></td></tr>
<tr class="freelancer-row"><td class="info-td"><a href="https://x.example/u/bob">Bob</a><p class="freelancer-title">Writer</td></tr><tr class="freelancer-row"><td class="info-td">no link</td></tr></table>"""

PROFILE_PAGE = """<html><h1 class="profile-name"><bdi>Ada L</bdi></h1><ul><li class="profile-title"><a>- Engineer</a><li class="profile-country">Jordan</ul>
<ul class="skills"><li class="skills__item"><a><bdi>sql</bdi></a><li class="skills__item"><a><bdi>unix</bdi></a></ul><div class="rating-stars"><i class="fa-star"></i><i class="fa-star"></i></div>
<div id="user-stats"><table class="table-meta"><tr><td><span>إكمال المشاريع</span></td><td>100.00%</td></tr><tr><td>إعادة التوظيف</td><td>41.33%</td></tr><tr><td>متوسط سرعة الرد</td><td>44 دقيقة</td></tr>
<tr><td>المشاريع المكتملة</td><td>113</td></tr><tr><td>تاريخ التسجيل</td><td>01 يونيو 2023</td></tr><tr><td>other</td><td>x</td></tr></table></div><div class="postcard cell-container"></div></html>"""


def _listings(spark, sf_dir) -> DataFrame:
    """Listing pages with a row per supplier, twenty keys a page."""
    row = F.format_string('<tr class="freelancer-row"><td class="details-td"><a href="/u/%d"><bdi>%s</bdi></a></td><td class="info-td"><img src="//img/%d.png"><p class="freelancer-title"> - %s</p></td></tr>', "s_suppkey", "s_name", "s_suppkey", "n_name")
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x.row)
    return rows.groupBy(F.floor(F.col("s_suppkey") / 20).cast("string").alias("url")).agg(F.concat(F.lit("<table>"), F.array_join(listed, ""), F.lit("</table>")).alias("html"))


@query("""SELECT (s_suppkey // 20)::VARCHAR AS url, (row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) - 1)::INT AS seq, s_name AS name, 'https://d/u/' || s_suppkey AS profile_url, '//img/' || s_suppkey || '.png' AS avatar_url, '- ' || n_name AS title, NULL::VARCHAR AS rank
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def directory_rows(spark, sf_dir):
    return pages.listings(_listings(spark, sf_dir), base="https://d")


def _raw(spark, sf_dir) -> DataFrame:
    """A profile page per supplier: its name, its nation, and its key as figures; every third has a portfolio, every seventh is blocked."""
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    filled = {"Ada L": F.col("s_name"), "Jordan": F.col("n_name"), "113": key, "41.33%": F.concat((F.col("s_suppkey") % 101).cast("string"), F.lit(".5%")), "44 دقيقة": F.concat((F.col("s_suppkey") % 59 + 1).cast("string"), F.lit(" دقيقة")), "<td>other": F.concat(F.lit("<td>"), F.col("n_name"))}
    # All at once: a name may hold what another place is known by.
    page = F.concat(*[filled.get(part, F.lit(part)) for part in re.split(f"({'|'.join(map(re.escape, filled))})", PROFILE_PAGE)])
    html = F.when(F.col("s_suppkey") % 7 == 0, F.concat(page, F.lit("<!-- cloudflare -->"))).otherwise(page)
    cards = F.when(F.col("s_suppkey") % 3 == 0, F.lit('<div class="postcard cell-container"></div>' * 4))
    return rows.select(F.concat(F.lit("u/"), key).alias("profile_url"), html.alias("html"), cards.alias("portfolio_html"))


@query("""SELECT 'u/' || s_suppkey AS profile_url, s_name AS name, 'Engineer' AS title, n_name AS location, 2.0::DOUBLE AS rating, 4 AS score, 'has_h1' AS parse_confidence, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 1 END AS portfolio_count, '100.00%' AS completion_rate,
  s_suppkey % 101 || '.5%' AS rehire_rate, s_suppkey % 59 + 1 || ' دقيقة' AS response_time, '01 يونيو 2023' AS member_since, 'sql,unix' AS skills FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0""")
def profile_records(spark, sf_dir):
    rows = pages.profiles(_raw(spark, sf_dir))
    return rows.select("profile_url", "name", "title", "location", "rating", "score", "parse_confidence", "portfolio_count", "completion_rate", "rehire_rate", "response_time", "member_since", F.array_join("skills", ",").alias("skills"))


@query("""SELECT 'u/' || s_suppkey AS profile_url, 100.0::DOUBLE AS completion_rate, (s_suppkey % 101 + 0.5)::DOUBLE AS rehire_rate, s_suppkey % 59 + 1 AS minutes, s_suppkey AS projects, 2 AS skills_count, '2023-06-01' AS joined FROM supplier WHERE s_suppkey % 7 <> 0""")
def profile_gold(spark, sf_dir):
    rows = leaderboard.gold(pages.profiles(_raw(spark, sf_dir)))
    return rows.select("profile_url", "completion_rate", "rehire_rate", F.col("avg_response_time_minutes").alias("minutes"), F.col("total_completed_projects").alias("projects"), "skills_count", values.date_of(F.col("member_since")).cast("string").alias("joined"))


@query("SELECT n_name AS label, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def label_inventory(spark, sf_dir):
    known = spark.createDataFrame([(pages.plain_label(k),) for k in pages.LABELS], "label string")
    return quality.unmapped_labels(pages.page_labels(_raw(spark, sf_dir), "profile_url"), known)


@query(f"""WITH s AS (SELECT unnest([{', '.join(f"'{x}'" for x in pages.LANDMARKS)}]) AS selector)
SELECT selector, page_id, CASE WHEN selector = 'h1' THEN len(regexp_extract_all(html, '<h1[ >]'))::INT ELSE 0 END AS hits FROM pages, s""")
def landmark_hits(spark, sf_dir):
    """All selectors on all pages; the given ones have headings, and nothing of a directory."""
    return pages.landmarks(_t(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("selector", "page_id", "hits")


# ---------------------------------------------------------------- paging and streams

@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, value < 5 AS empty FROM events), g AS (SELECT user_id, min(page) FILTER (empty) AS gap FROM p GROUP BY user_id)
SELECT user_id, event_id, page FROM p JOIN g USING (user_id) WHERE page < coalesce(gap, 11) AND page <= 10""")
def take_until_empty(spark, sf_dir):
    numbered = ordered.numbered(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), [F.col("event_id")], ["user_id"], "page")
    return records.until_empty(numbered, "user_id", "page", F.col("value") < 5, 10).select("user_id", "event_id", _long("page").alias("page"))


@query("""SELECT max(p) AS most, min(nullif(p, 0)) AS least, sum(p)::BIGINT AS pages, count_if(p = 0)::BIGINT AS empty FROM (SELECT user_id, coalesce(max(event_id % 50) FILTER (value >= 5), 0) AS p FROM events GROUP BY user_id)""")
def max_page_found(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).cast("int").alias("page"), "value")
    found = records.last_pages(rows, "user_id", "page", F.col("value") < 5)
    stats = records.page_stats(found)
    return stats.select(_long("most").alias("most"), _long("least").alias("least"), "pages", _long("empty").alias("empty"))


def _event_stream(spark, sf_dir) -> DataFrame:
    source = f"{sf_dir}/events.parquet"
    return streams.channel(spark, source, spark.read.parquet(source).schema)


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    return streams.drained(streams.unique(_event_stream(spark, sf_dir).select("user_id"), "user_id"), _folder(spark))


@query("SELECT user_id AS key, min(event_id) AS first, count(*) - 1 AS again FROM events GROUP BY user_id")
def stream_first_seen(spark, sf_dir):
    rows = streams.drained(streams.first_seen(_event_stream(spark, sf_dir), "user_id", "event_id"), _folder(spark))
    return rows.groupBy("key").agg(F.min("first").alias("first"), F.sum("again").alias("again"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    rows = streams.drained(streams.windowed_counts(_event_stream(spark, sf_dir), "ts", "1 hour", group="event_type"), _folder(spark), "complete")
    return rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), n AS (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS started, count(*) AS n FROM n GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    rows = streams.sessions(_t(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


# ---------------------------------------------------------------- sources and sinks

def _folder(spark) -> str:
    """A new folder that driver and executors share; a local one only in one process (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/tessera/{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="tessera-")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents")
    path = _folder(spark)
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    """All documents, in two writes of which the second appends."""
    rows = _t(spark, sf_dir, "documents")
    path = _folder(spark)
    short = F.coalesce(F.col("n_chars") < 1000, F.lit(True))
    files.write_jsonl(rows.where(short), path)
    files.write_jsonl(rows.where(~short), path, append=True)
    return files.read_jsonl(spark, path, rows.schema)


@query("SELECT conv_id, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn) || ']' AS roles FROM conversations GROUP BY conv_id")
def nested_json(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("roles"))
    return files.nested_as_json(rows)


@query("SELECT n_name AS label, n_nationkey AS last_page FROM nation")
def page_cache_read(spark, sf_dir):
    """Page counts of nations, written as the JSON object that the cache is, and read again."""
    path = _folder(spark)
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))  # a row per label
    _t(spark, sf_dir, "nation").agg(F.to_json(entries).alias("value")).write.text(path)
    return files.read_page_cache(spark, path)


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), ())")
def one_dim_at_a_time(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupingSets([["r_name"], ["n_name"], []], "r_name", "n_name").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- phases over stored pages

_LISTED = """listed AS (SELECT page_id, url, 'development+rating=' || (page_id % 5 + 1) AS label, page_id // 5 + 1 AS page, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)', 1)), '') AS title FROM pages)"""


def _listed(spark, sf_dir) -> DataFrame:
    """Every stored page as one row of a listing page of its own, five ratings in turn."""
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", F.nullif(F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1)), F.lit("")).alias("title"))
    entry = F.concat(
        F.lit('<table><tr class="freelancer-row"><td class="details-td"><a href="'), F.col("url"), F.lit('"><bdi>'), F.coalesce("title", F.lit("")), F.lit('</bdi></a></td><td class="info-td"><p class="freelancer-title">'),
        F.coalesce("title", F.lit("")), F.lit("</p></td></tr></table>"))
    return rows.withColumn("rating", (F.col("page_id") % 5 + 1).cast("string")).withColumn("label", combos.label(F.lit("rating"), F.col("rating"))).withColumn("page", F.floor(F.col("page_id") / 5).cast("int") + 1).withColumn("html", entry)


@query(f"WITH {_LISTED} SELECT label, max(page)::BIGINT AS last_page FROM listed GROUP BY label UNION ALL SELECT 'development (base)', 0")
def phase_discovery(spark, sf_dir):
    """Page counts of the base and the ratings from stored listing pages."""
    engine = Engine(spark, pages_by_url(spark.createDataFrame([], "url string, html string")), dims={"titles": (), "skills": (), "country": ()})
    return engine.discovery(_listed(spark, sf_dir).select("label", "page", "html")).select("label", _long("last_page").alias("last_page"))


_ALL = [combos.BASE_LABEL, *(f"{combos.LABEL}{d}={v}" for d, values_ in (("rating", combos.RATINGS), ("titles", combos.TITLES), ("skills", combos.SKILLS), ("country", combos.COUNTRIES)) for v in values_)]


@query(f"""WITH combos AS (SELECT unnest({_ALL!r}) AS label, unnest(range({len(_ALL)})) AS seq), stored AS (SELECT o_orderkey % {len(_ALL)} AS seq, (o_orderkey // {len(_ALL)})::INT + 1 AS page FROM orders WHERE o_orderstatus <> 'P'),
cache AS (SELECT DISTINCT c_custkey % {len(_ALL)} AS seq FROM customer WHERE c_acctbal > 9000)
SELECT label, coalesce(max(page), 0)::BIGINT AS last_page FROM combos LEFT JOIN stored USING (seq) WHERE combos.seq NOT IN (SELECT seq FROM cache) GROUP BY label""")
def phase_discovery_resumed(spark, sf_dir):
    """Page counts of all combinations that the cache of an earlier run lacks. Orders stand for stored pages, dealt over all combinations; rich customers for cached ones."""
    engine = Engine(spark, pages_by_url(spark.createDataFrame([], "url string, html string")))
    labels = combos.combinations(spark).select("seq", combos.label(F.col("dim"), F.col("value")).alias("label"))
    n, key = len(_ALL), F.col("o_orderkey")
    html = F.when(F.col("o_orderstatus") == "P", "<p>none").otherwise('<tr class="freelancer-row">')
    stored = _t(spark, sf_dir, "orders").select((key % n).alias("seq"), (F.floor(key / n) + 1).cast("int").alias("page"), html.alias("html")).join(F.broadcast(labels), "seq")  # 336 labels
    cache = _t(spark, sf_dir, "customer").where("c_acctbal > 9000").select((F.col("c_custkey") % n).alias("seq")).distinct().join(labels, "seq").select("label", F.lit(1).alias("last_page"))
    return engine.discovery(stored.select("label", "page", "html"), cache).select("label", _long("last_page").alias("last_page"))


@query(f"WITH {_LISTED} SELECT DISTINCT url AS profile_url FROM listed")
def phase_extract(spark, sf_dir):
    """Unique listing rows of all stored listing pages, by their page counts."""
    listed = _listed(spark, sf_dir)
    address = combos.listing_url(Config().base_url, F.lit("rating"), F.col("rating"), F.lit(None).cast("string"), F.col("page"))
    engine = Engine(spark, pages_by_url(listed.select(address.alias("url"), "html")), dims={"titles": (), "skills": (), "country": ()})
    counts = engine.discovery(listed.select("label", "page", "html"))
    return engine.extract(counts).select("profile_url")


@query("""WITH first AS (SELECT DISTINCT ON (url) url, html FROM pages ORDER BY url, page_id)
SELECT url AS profile_url, octet_length(encode(html))::BIGINT AS bytes FROM first""")
def phase_fetch(spark, sf_dir):
    stored = records.first_per_key(_t(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "page_id").select("url", "html")
    engine = Engine(spark, pages_by_url(stored))
    rows = engine.fetch_pages(_t(spark, sf_dir, "pages").select(F.col("url").alias("profile_url")))
    return rows.select("profile_url", F.octet_length("html").cast("long").alias("bytes"))


@query("""WITH last AS (SELECT DISTINCT ON (url) url, html FROM pages ORDER BY url, page_id DESC), f AS (SELECT url, html, contains(html, '<h1') AS h1, length(html) >= 2000 AS big, contains(lower(html), 'cloudflare') AS shut FROM last)
SELECT url AS profile_url, 'Unknown' AS name, 'development' AS category FROM f WHERE h1 AND big AND NOT shut""")
def phase_parse(spark, sf_dir):
    """Stored pages as raw pages, the last of each address; none has a profile's name, those that are trusted become records."""
    engine = Engine(spark, pages_by_url(spark.createDataFrame([], "url string, html string")), Config(min_html=2000))
    raw = _t(spark, sf_dir, "pages").select("page_id", F.col("url").alias("profile_url"), "html", F.lit(None).cast("string").alias("portfolio_html"))
    return engine.parse(raw, confidence=2, seq="page_id").select("profile_url", "name", "category")


@query("""SELECT DISTINCT nullif(split_part(trim(name), ' ', 1), '') AS keyword FROM clients WHERE trim(name) <> ''""")
def phase_followup(spark, sf_dir):
    """First words of all clients' names."""
    engine = Engine(spark, pages_by_url(spark.createDataFrame([], "url string, html string")))
    return engine.followup(_t(spark, sf_dir, "clients").select("name")).select("keyword")


@query("SELECT page_id::VARCHAR AS profile_url, regexp_extract(url, '://([^/?#]+)', 1) AS title FROM pages")
def phase_fixup(spark, sf_dir):
    """Listing rows without a title, repaired from profile pages that carry it (the page's host)."""
    rows = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("profile_url"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("found"))
    profile = F.concat(F.lit('<html><h1 class="profile-name"><bdi>x</bdi></h1><ul><li class="profile-title">'), F.col("found"), F.lit('</li></ul><ul class="skills"><li class="skills__item"><bdi>s</bdi></li></ul></html>'))
    engine = Engine(spark, pages_by_url(rows.select(F.col("profile_url").alias("url"), profile.alias("html"))), Config(min_html=0, min_confidence=1))
    listing = rows.select(F.lit("n").alias("name"), "profile_url", F.lit(None).cast("string").alias("avatar_url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("rank"))
    return engine.fixup(listing).select("profile_url", "title")


@query("""SELECT sha256(string_agg(s_name, chr(10) ORDER BY s_name) || chr(10)) AS sha256, (sum(octet_length(encode(s_name))) + count(*))::BIGINT AS length FROM supplier GROUP BY s_nationkey""")
def uploads_by_content(spark, sf_dir):
    """A file per nation with its suppliers' names, by its content, whatever its name."""
    path = _folder(spark)
    _t(spark, sf_dir, "supplier").select("s_nationkey", "s_name").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(path)
    return files.read_uploads(spark, path).select("sha256", "length")
