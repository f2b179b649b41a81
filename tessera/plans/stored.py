"""Registered queries that write records and read them back, and of the phases' reports, rates and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import combos, text
from ..operators import metrics, records
from ..sources import files
from ..sources.shared import folder
from ..streaming import streams
from .engine import Config, Engine, pages_by_url
from .queries import _LISTED, _listed
from .registry import query, table

# ---------------------------------------------------------------- files

_VENDORS = "SELECT vendor_id, name, nation_id, balance FROM vendors"


def _arrays(spark: SparkSession, sf_dir: str, wrap) -> tuple[str, DataFrame]:
    """Vendors as files of a JSON array of at most hundred records each, wrapped; and the table."""
    rows = table(spark, sf_dir, "vendors").select("vendor_id", "name", "nation_id", "balance")
    chunk = F.floor(F.col("vendor_id") / 100).alias("chunk")
    arrays = rows.groupBy(chunk).agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
    path = folder(spark, "arrays")
    arrays.select("chunk", wrap(F.col("value")).alias("value")).write.partitionBy("chunk").text(path)
    return path, rows


@query(_VENDORS)
def json_arrays(spark, sf_dir):
    path, rows = _arrays(spark, sf_dir, lambda v: v)
    return files.read_json(spark, path, rows.schema).select(rows.columns)


@query(_VENDORS)
def json_objects(spark, sf_dir):
    """Objects whose first list holds the records, with other keys before and after it."""
    path, rows = _arrays(spark, sf_dir, lambda v: F.concat(F.lit('{"source": "shop", "rows": '), v, F.lit(', "others": [{"vendor_id": -1}]}')))
    return files.read_any_json(spark, path, rows.schema)


@query("SELECT vendor_id, name, nation_id, balance, 2 AS formats FROM vendors")
def export_formats(spark, sf_dir):
    """Vendors exported as JSON lines and as CSV, each read again."""
    rows, path = table(spark, sf_dir, "vendors").select("vendor_id", "name", "nation_id", "balance"), folder(spark, "export")
    files.export(rows, f"{path}/json", f"{path}/csv")
    both = files.read_jsonl(spark, f"{path}/json", rows.schema).unionByName(files.read_csv(spark, f"{path}/csv", rows.schema))
    return both.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("formats"))


@query("SELECT count(*) AS n FROM clicks")
def discarded_rows(spark, sf_dir):
    """Rows of a plan that is run for its count only."""
    return spark.createDataFrame([(files.discard(table(spark, sf_dir, "clicks").select("click_id")),)], "n long")


@query("SELECT event_type, count(*) AS at_rest, count(*) AS streamed FROM events GROUP BY 1")
def seeded_stream(spark, sf_dir):
    """One transform on the same rows at rest and as a stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rest, moving = (streams.seeded(spark, path, schema, s).select("event_type", F.lit(s).alias("moving")) for s in (False, True))
    both = rest.unionByName(streams.drained(moving, folder(spark, "seeded")))
    return both.groupBy("event_type").agg(F.count_if(~F.col("moving")).alias("at_rest"), F.count_if("moving").alias("streamed"))


# ---------------------------------------------------------------- rates, reports and limits

@query("""SELECT o_custkey, round(CASE WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 THEN count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*) FILTER (o_orderstatus <> 'O') ELSE 100 END, 6)::DOUBLE AS repaired,
  round(CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN count(*) FILTER (o_orderstatus = 'P') / count(*) FILTER (o_orderstatus = 'F') ELSE 0 END, 6)::DOUBLE AS missing FROM orders GROUP BY 1""")
def repair_rates(spark, sf_dir):
    """Per customer the percentage of finished orders among those that were begun, and open parts per finished one."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FPO"])
    return counts.select("o_custkey", F.round(metrics.repair_rate(F.col("F"), F.col("F") + F.col("P")), 6).alias("repaired"), F.round(metrics.average_missing(F.col("P"), F.col("F")), 6).alias("missing"))


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 AND p_size > 0 THEN (p_partkey % 7) / p_size ELSE 1 - 1 / (1 + (p_partkey % 7) / 20) END, 9) AS credit, least(30.0 * pow(2, p_size % 5), 120.0)::DOUBLE AS pause FROM part""")
def progress_and_pauses(spark, sf_dir):
    """Shares of pages done, with and without a known last page, and cooldowns after refusals."""
    page, last = F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.progress_credit(page, last), 9).alias("credit"), text.penalty_seconds(F.col("p_size") % 5 + 1, F.lit(1.0)).alias("pause"))


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_event(spark, sf_dir):
    """The bar that was updated last; of those, the one made last."""
    bars = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("last_update"), F.col("event_id").alias("created_at"))
    return metrics.latest_bar(bars).select("event_id", "user_id", F.col("last_update").alias("ts"))


@query("""WITH u AS (SELECT DISTINCT url FROM pages), n AS (SELECT url, row_number() OVER (ORDER BY url) AS k FROM u)
SELECT 'all' AS mode, url FROM n UNION ALL SELECT 'seven', url FROM n WHERE k <= 7""")
def limit_modes(spark, sf_dir):
    """The cap on urls: no cap, a seeded run's 0 (none), a streamed run's 0 (nothing), and seven."""
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    modes = [("all", records.limited(urls, 0, True, "url")), ("none", records.limited(urls, 0, False, "url")), ("seven", records.limited(urls, 7, False, "url"))]
    found = None
    for name, rows in modes:
        named = rows.select(F.lit(name).alias("mode"), "url")
        found = named if found is None else found.unionByName(named)
    return found


@query("""WITH first AS (SELECT DISTINCT ON (url) url, html FROM pages ORDER BY url, page_id), f AS (SELECT url, contains(html, '<h1') AS h1, length(html) >= 2000 AS big, contains(lower(html), 'cloudflare') AS shut FROM first)
SELECT url AS profile_url, 'Unknown' AS name FROM f WHERE h1 AND big AND NOT shut""")
def phase_deep_scrape(spark, sf_dir):
    """Fetching and parsing in one: stored pages of all addresses, each parsed once."""
    stored = records.first_per_key(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "page_id").select("url", "html")
    engine = Engine(spark, pages_by_url(stored), Config(min_html=2000, min_confidence=2))
    return engine.run("deep_scrape", listing=table(spark, sf_dir, "pages").select(F.col("url").alias("profile_url"))).select("profile_url", "name")


@query(f"""WITH {_LISTED}, counts AS (SELECT label, max(page) AS last_page FROM listed GROUP BY label)
SELECT 'discovery' AS phase, 'rows' AS metric, 6.0::DOUBLE AS value, 3 AS position UNION ALL SELECT 'discovery', 'with_pages', count(*)::DOUBLE, 3 FROM counts UNION ALL SELECT 'discovery', 'pages', sum(last_page)::DOUBLE, 3 FROM counts
UNION ALL SELECT 'followup', 'rows', count(DISTINCT split_part(trim(name), ' ', 1))::DOUBLE, 1 FROM clients WHERE trim(name) <> ''""")
def phase_report(spark, sf_dir):
    """What the phases counted while their rows were used, in the order of phases."""
    engine = Engine(spark, pages_by_url(spark.createDataFrame([], "url string, html string")), dims={"titles": (), "skills": (), "country": ()})
    for phase in (engine.discovery(_listed(spark, sf_dir).select("label", "page", "html")), engine.followup(table(spark, sf_dir, "clients").select("name"))):
        phase.write.format("noop").mode("overwrite").save()
    return engine.report().select("phase", "metric", "value", F.col("position").cast("int").alias("position"))


@query("""SELECT 'development+country=' || n_name AS label, n_nationkey + 1 AS last_page FROM nation WHERE n_nationkey >= 0 ORDER BY 1 LIMIT 10""")
def sampled_jobs(spark, sf_dir):
    """A few jobs of all, by their order."""
    jobs = table(spark, sf_dir, "nation").select(combos.label(F.lit("country"), F.col("n_name")).alias("label"), (F.col("n_nationkey") + 1).alias("last_page"))
    return records.paged(jobs, 0, 10, "label")
