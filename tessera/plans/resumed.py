"""Registered queries of phases that go on from earlier work: resumed extraction, keyword paging, suppressed streams, stages side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import combos
from ..operators import ordered, records
from ..sources.shared import folder
from ..streaming import streams
from .engine import Config, Engine, pages_by_url
from .queries import _LISTED, _event_stream, _listed
from .registry import query, table


@query(f"""WITH {_LISTED}, urls AS (SELECT DISTINCT url FROM listed), done AS (SELECT url FROM urls WHERE contains(url, '?')), new AS (SELECT url FROM urls WHERE NOT contains(url, '?') AND NOT contains(url, '://www.'))
SELECT url AS profile_url FROM (SELECT url FROM done UNION ALL SELECT url FROM new) ORDER BY 1 LIMIT 150""")
def phase_extract_resumed(spark, sf_dir):
    """Listing rows of an earlier run, then the new ones that are not suppressed, cut to a limit."""
    listed = _listed(spark, sf_dir)
    address = combos.listing_url(Config().base_url, F.lit("rating"), F.col("rating"), F.lit(None).cast("string"), F.col("page"))
    engine = Engine(spark, pages_by_url(listed.select(address.alias("url"), "html")), dims={"titles": (), "skills": (), "country": ()})
    first = records.first_per_key(listed.select("url", "page_id", "title"), "url", "page_id")
    text = lambda c: c.cast("string")
    existing = first.where(F.contains("url", F.lit("?"))).select(text(F.col("title")).alias("name"), F.col("url").alias("profile_url"), text(F.lit(None)).alias("avatar_url"), text(F.col("title")).alias("title"), text(F.lit(None)).alias("rank"))
    known = first.where(F.contains("url", F.lit("://www."))).select(F.col("url").alias("profile_url"))
    counts = engine.discovery(listed.select("label", "page", "html"))
    return engine.extract(counts, suppress=known, existing=existing, limit=150).select("profile_url")


@query("""WITH p AS (SELECT lower(c_mktsegment) AS keyword, c_custkey // 20 + 1 AS page, c_custkey, c_acctbal > 9900 AS blank FROM customer), gaps AS (SELECT keyword, page FROM p GROUP BY ALL HAVING bool_or(blank)),
first AS (SELECT keyword, least(min(k), 31) AS gap FROM (SELECT keyword, unnest(generate_series(1, 31)) AS k FROM (SELECT DISTINCT keyword FROM p)) a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.keyword = a.keyword AND p.page = k) OR EXISTS (SELECT 1 FROM gaps g WHERE g.keyword = a.keyword AND g.page = k) OR k = 31 GROUP BY keyword)
SELECT 'https://d/u/' || c_custkey AS profile_url FROM p JOIN first USING (keyword) WHERE page < gap""")
def phase_extract_keywords(spark, sf_dir):
    """Listing rows by keyword, page by page until the first page of a keyword that is missing or has no rows."""
    config = Config(base_url="https://d/l", followup_pages=30)
    customers = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("keyword"), (F.floor(F.col("c_custkey") / 20) + 1).cast("int").alias("page"), "c_custkey", "c_name", (F.col("c_acctbal") > 9900).alias("blank"))
    row = F.format_string('<tr class="freelancer-row"><td class="details-td"><a href="https://d/u/%d"><bdi>%s</bdi></a></td></tr>', "c_custkey", "c_name")
    pages = customers.groupBy("keyword", "page").agg(F.when(F.bool_or("blank"), "<p>none").otherwise(F.array_join(F.collect_list(row), "")).alias("html"))  # twenty customers at most
    address = combos.listing_url(config.base_url, F.lit("base"), F.lit(None).cast("string"), F.col("keyword"), F.col("page"))
    engine = Engine(spark, pages_by_url(pages.select(address.alias("url"), "html")), config)
    keywords = records.keywords(customers.select(F.col("keyword").alias("name")))
    return engine.extract(keywords).select("profile_url")


@query("""SELECT user_id AS key, min(event_id) AS first, count(*) - 1 AS again, user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS suppressed FROM events GROUP BY user_id""")
def stream_first_seen_suppressed(spark, sf_dir):
    """First-seen users of a stream; those with urgent orders are suppressed."""
    known = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    rows = streams.drained(streams.first_seen(_event_stream(spark, sf_dir), "user_id", "event_id", known), folder(spark, "suppressed"))
    return rows.groupBy("key").agg(F.min("first").alias("first"), F.sum("again").alias("again"), F.bool_or("suppressed").alias("suppressed"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type <> 'view'")
def stream_stages(spark, sf_dir):
    """Two stages side by side: one filters the stream of events into a table, the other reads that as it grows and keeps each user once."""
    steps = {
        "acted": (lambda: _event_stream(spark, sf_dir).where("event_type <> 'view'").select("user_id"), "user_id long"),
        "users": (lambda rows: streams.unique(rows, "user_id"), "user_id long")}
    path = folder(spark, "stages")
    running = streams.chained(steps, path)
    try:
        for stage in running.values():  # a stage has all its input when the one before it is done
            stage.processAllAvailable()
    finally:
        for stage in running.values():
            stage.stop()
    return spark.read.schema("user_id long").parquet(f"{path}/users")


@query("""WITH f AS (SELECT c_name AS path, c_acctbal AS modified FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier)
SELECT path, path LIKE '%7' AS is_current, row_number() OVER (ORDER BY path LIKE '%7' DESC, modified DESC, path) AS place FROM f""")
def result_files(spark, sf_dir):
    """Names of two sources as result files: current ones first, then the latest; each with its place in the list."""
    files = [table(spark, sf_dir, t).select(F.col(f"{c}_name").alias("path"), F.col(f"{c}_acctbal").alias("modified")) for t, c in (("customer", "c"), ("supplier", "s"))]
    found = records.by_priority(files, "path", F.col("path").endswith("7"), "modified")
    return ordered.numbered(found, [F.desc("is_current"), F.desc("modified"), F.col("path")], name="place").select("path", "is_current", "place")
