"""Registered queries over the shop's tables: sketches, recursion, variants, repairs, comparisons, streams with two clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import differing, gallop, postings, records, shapes, sketches
from ..sources import buckets
from ..sources.shared import folder
from ..streaming import expiring, late, streams
from .registry import query, table

# ---------------------------------------------------------------- aggregates


@query("""SELECT grouping(status) * 4 + grouping(priority) * 2 + grouping(month) AS level, status, priority, month, count(*) AS n, sum(total::DECIMAL(18,2)) AS revenue
FROM (SELECT status, priority, year(sold_at) * 100 + month(sold_at) AS month, total FROM sales WHERE NOT coalesce(isnan(total), false)) GROUP BY CUBE (status, priority, month)""")
def sales_cube(spark, sf_dir):
    """Sales and revenue by every subset of status, priority and month."""
    rows = table(spark, sf_dir, "sales").where(~F.coalesce(F.isnan("total"), F.lit(False))).select("status", "priority", (F.year("sold_at") * 100 + F.month("sold_at")).alias("month"), F.col("total").cast("decimal(18,2)").alias("total"))
    return rows.cube("status", "priority", "month").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("total").alias("revenue"))


@query("""WITH c AS (SELECT kind, year(ts) * 100 + month(ts) AS month, client_id FROM clicks)
SELECT (grouping(kind) * 2 + grouping(month))::BIGINT AS level, kind, month, count(*) AS n, true AS distinct_near, true AS median_near, true AS top_near FROM c GROUP BY ROLLUP (kind, month)""")
def click_sketches(spark, sf_dir):
    """Sketches of clicks per day, stored and rolled up by kind and month; each estimate is held against the exact rows."""
    clicks = table(spark, sf_dir, "clicks").select("ts", "kind", "client_id", "value")
    path = folder(spark, "click-days")
    sketches.stored(sketches.daily(clicks, "ts", ["kind"], "client_id", "value", "client_id"), path)
    month = (F.year("day") * 100 + F.month("day")).alias("month")
    rolled = sketches.rolled(spark.read.parquet(path).select("kind", month, "n", "distinct", "values", "items"), ["kind", "month"])
    told = sketches.answers(rolled, [0.5], 1).select("level", "kind", "month", "n", "distinct", F.col("values")[0].alias("median"), F.col("items")[0]["count"].alias("top"))
    # The exact side: every row under each of its groups, at the three levels.
    own, none = F.year("ts") * 100 + F.month("ts"), F.lit(None).cast("int")
    spot = lambda level, kind, m: F.struct(F.lit(level).cast("long").alias("level"), kind.alias("kind"), m.alias("month"))
    groups = F.array(spot(0, F.col("kind"), own), spot(1, F.col("kind"), none), spot(3, F.lit(None).cast("string"), none))
    rows = clicks.select(F.explode(groups).alias("g"), "client_id", "value").select("g.*", "client_id", "value")
    same = F.lit(True)
    for c in ("level", "kind", "month"):
        same &= F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}"))
    ranks = rows.alias("e").join(told.alias("t"), same).groupBy(*[F.col(f"t.{c}") for c in ("level", "kind", "month", "n", "distinct", "median", "top")]).agg(
        F.count_if(F.col("value") <= F.col("median")).alias("below"), F.count_if(F.col("value") < F.col("median")).alias("under"), F.count_if(F.col("value").isNotNull() & ~F.isnan("value")).alias("values"))
    counts = rows.where("client_id IS NOT NULL").groupBy("level", "kind", "month", "client_id").agg(F.count(F.lit(1)).alias("k")).groupBy("level", "kind", "month").agg(F.count(F.lit(1)).alias("exact"), F.max("k").alias("most"))
    both = ranks.alias("e").join(counts.alias("t"), same, "left")
    share = lambda c: F.col(c) / F.greatest("values", F.lit(1))
    near = F.abs(F.col("distinct") - F.coalesce("exact", F.lit(0))) <= sketches.DISTINCT_ERROR * F.coalesce("exact", F.lit(0)) + 1
    middle = F.col("median").isNull() & (F.col("values") == 0) | (share("below") >= 0.5 - sketches.RANK_ERROR) & (share("under") <= 0.5 + sketches.RANK_ERROR)
    top = F.abs(F.coalesce("top", F.lit(0)) - F.coalesce("most", F.lit(0))) <= sketches.COUNT_ERROR * F.col("n")
    return both.select("e.level", "e.kind", "e.month", "n", near.alias("distinct_near"), F.coalesce(middle, F.lit(False)).alias("median_near"), top.alias("top_near"))


@query("SELECT p_partkey AS label, greatest(p_size, 0)::BIGINT AS last_page FROM part")
def discovery_gallop(spark, sf_dir):
    """How many pages every part has, by doubling and halving over the stored pages of all parts at once."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), "p_size")
    return gallop.last_pages(records.pages_of(parts, "p_size").select("label", "page"), parts)


# ---------------------------------------------------------------- records of unknown shape

_JSON = "CASE WHEN json_valid(props) THEN props::JSON END"


@query(f"""SELECT click_id, (j->>'$.k')::BIGINT AS k, j->>'$.device.os' AS os, (j->>'$.items[0].sku')::BIGINT AS first_sku, CASE WHEN json_type(j, '$.tags') = 'ARRAY' THEN array_to_string(list_transform(from_json(j->'$.tags', '["VARCHAR"]'), lambda t: coalesce(t, '?')), ',') END AS tags
FROM (SELECT click_id, {_JSON} AS j FROM clicks)""")
def click_properties(spark, sf_dir):
    """Typed fields of the properties of all clicks; texts that are no JSON have none."""
    rows = shapes.parsed(table(spark, sf_dir, "clicks").select("click_id", "props"), "props")
    found = shapes.typed(rows, "shape", {"k": ("$.k", "bigint"), "os": ("$.device.os", "string"), "first_sku": ("$.items[0].sku", "bigint"), "tags": ("$.tags", "array<string>")})
    return found.select("click_id", "k", "os", "first_sku", F.array_join("tags", ",", "?").alias("tags"))


@query(f"""WITH t AS (SELECT regexp_replace(x.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path, x.type AS type FROM (SELECT {_JSON} AS j FROM clicks) c, json_tree(c.j) x WHERE c.j IS NOT NULL)
SELECT path, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) ELSE 'number' END AS kind, count(*) AS n FROM t GROUP BY ALL""")
def property_paths(spark, sf_dir):
    """Every path in the properties of all clicks, and what is found there."""
    return shapes.inventory(shapes.parsed(table(spark, sf_dir, "clicks").select("props"), "props"), "shape")


# ---------------------------------------------------------------- repairs and comparisons

_LATEST = """last AS (SELECT client_id, max_by(struct_pack(city := city, balance := balance, op := op), (seq, valid_at, change_id)) AS r FROM (SELECT * FROM client_changes WHERE client_id IS NOT NULL) GROUP BY client_id),
fix AS (SELECT client_id, r.city AS city, r.balance AS balance FROM last WHERE r.op <> 'D')"""


def _fixes(spark, sf_dir):
    """The last change of every client, if it is no deletion."""
    changes = table(spark, sf_dir, "client_changes").where("client_id IS NOT NULL").withColumn("_seq", F.struct("seq", "valid_at", "change_id"))
    return records.last_per_key(changes, "client_id", "_seq").where("op <> 'D'").select("client_id", "city", "balance")


@query(f"""WITH {_LATEST} SELECT coalesce(c.client_id, f.client_id) AS client_id, name, coalesce(f.city, c.city) AS city, coalesce(f.balance, c.balance) AS balance
FROM clients c FULL JOIN fix f ON c.client_id = f.client_id""")
def repaired_clients(spark, sf_dir):
    """Clients in a bucketed table, repaired by their last changes; a second run of the same repairs rewrites nothing."""
    clients = table(spark, sf_dir, "clients").select("client_id", "name", "city", "balance")
    path, fixes = folder(spark, "clients"), _fixes(spark, sf_dir)
    buckets.create(clients, path, "client_id")
    buckets.merge(spark, path, clients.schema, fixes, "client_id", ["city", "balance"])
    again = buckets.merge(spark, path, clients.schema, fixes, "client_id", ["city", "balance"])
    if again["buckets"]:
        raise RuntimeError(f"a second run changed {again}")
    return buckets.load(spark, path, clients.schema).drop("bucket")


@query(f"""WITH {_LATEST}, j AS (SELECT coalesce(c.client_id, f.client_id) AS client_id, c.client_id IS NULL AS ns, f.client_id IS NULL AS np, c.city AS sc, f.city AS pc, c.balance AS sb, f.balance AS pb FROM (SELECT * FROM clients WHERE client_id IS NOT NULL) c FULL JOIN fix f ON c.client_id = f.client_id),
cells AS (SELECT client_id, 'city' AS field, ns, np, sc AS stored, pc AS parsed FROM j UNION ALL SELECT client_id, 'balance', ns, np, (sb * 100)::BIGINT::VARCHAR, (pb * 100)::BIGINT::VARCHAR FROM j)
SELECT client_id, field, CASE WHEN ns THEN 'only_parsed' WHEN np THEN 'only_stored' WHEN stored IS NULL THEN 'filled' WHEN parsed IS NULL THEN 'lost' ELSE 'changed' END AS kind, stored, parsed FROM cells WHERE stored IS DISTINCT FROM parsed""")
def client_differences(spark, sf_dir):
    """Clients as stored against their last changes, by a tree of checksums."""
    cents = F.round(F.col("balance") * 100).cast("long").alias("balance")
    return differing.differences(table(spark, sf_dir, "clients").select("client_id", "city", cents), _fixes(spark, sf_dir).select("client_id", "city", cents), "client_id", ["city", "balance"])


# ---------------------------------------------------------------- streams

@query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM n GROUP BY user_id, run)
SELECT user_id, first, last, n FROM r WHERE date_trunc('milliseconds', last + INTERVAL 30 MINUTES + INTERVAL 999 MICROSECONDS) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM events)""")
def stream_first_seen_again(spark, sf_dir):
    """First rows of users that had been away for half an hour, given out when that is certain."""
    path = f"{sf_dir}/events.parquet"
    rows = expiring.first_seen_again(streams.channel(spark, path, spark.read.parquet(path).schema), "user_id", "ts", "30 minutes")
    out = streams.drained(rows, folder(spark, "first-seen-again"))
    return out.select(F.col("key").alias("user_id"), F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    return streams.channel(spark, path, spark.read.parquet(path).schema)


@query("SELECT click_id, client_id, kind, ts, arrived_at FROM clicks WHERE ts IS NULL OR arrived_at - ts > INTERVAL 1 HOUR")
def stream_late_clicks(spark, sf_dir):
    """Clicks that arrived more than an hour after their time, or have none, from a stream into a table of their own."""
    return streams.drained(late.late_rows(_stream(spark, sf_dir, "clicks").select("click_id", "client_id", "kind", "ts", "arrived_at"), "ts", "arrived_at", "1 hour"), folder(spark, "late"))


@query("""WITH c AS (SELECT * FROM clicks WHERE ts IS NOT NULL AND NOT coalesce(arrived_at - ts > INTERVAL 1 HOUR, false)), s AS (SELECT * FROM sales WHERE sold_at IS NOT NULL AND NOT coalesce(arrived_at - sold_at > INTERVAL 1 HOUR, false))
SELECT click_id, sale_id, ts, sold_at FROM c JOIN s ON c.client_id = s.client_id AND sold_at >= ts AND sold_at <= ts + INTERVAL 2 HOURS""")
def stream_click_sales(spark, sf_dir):
    """Sales within two hours after a click of their client, from two streams; late rows of either have no part."""
    clicks = late.on_time(_stream(spark, sf_dir, "clicks").select("click_id", "client_id", "ts", "arrived_at"), "ts", "arrived_at", "1 hour")
    sales = late.on_time(_stream(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at", "arrived_at"), "sold_at", "arrived_at", "1 hour")
    pairs = late.matched(clicks, sales, "client_id", "ts", "sold_at", "2 hours", "1 hour")
    return streams.drained(pairs.select("l.click_id", "r.sale_id", "l.ts", "r.sold_at"), folder(spark, "click-sales"))


# ---------------------------------------------------------------- search

_ASKED = ("ation", "ther", "é é", "zzzz")


@query(f"SELECT q, doc_id, 1000 - (instr(lower(text), q) - 1)::BIGINT AS score FROM documents, (SELECT unnest([{', '.join(f"'{q}'" for q in _ASKED)}]) AS q) WHERE instr(lower(text), q) > 0")
def search_indexed(spark, sf_dir):
    """Literal search in all documents through an index of trigrams; no text is read after the index is built."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), folder(spark, "postings")
    postings.build(docs, "doc_id", "text", path)
    index, found = spark.read.parquet(path), None
    for q in _ASKED:
        hits = postings.hits(index, q).select(F.lit(q).alias("q"), F.col("key").alias("doc_id"), (1000 - F.col("first")).cast("long").alias("score"))
        found = hits if found is None else found.unionByName(hits)
    return found
