"""Registered queries over the order of time: as-of and overlap joins, sessions, running and framed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, temporal
from .registry import query, table


@query("""WITH s AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_orderkey) AS o FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL)
SELECT event_id, o AS o_orderkey FROM events e ASOF LEFT JOIN s ON e.user_id = s.k AND e.ts >= s.at""")
def asof_order_of_event(spark, sf_dir):
    """For every event the latest order of its user before it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    found = temporal.as_of(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", "o_orderdate", "o_orderkey")
    return found.select("event_id", F.col("match.o_orderkey").alias("o_orderkey"))


_SALES = "s AS (SELECT client_id, sold_at, {}(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_SALES.format('max')} SELECT click_id, c.client_id, sale_id, date_diff('second', sold_at, ts) // 60 AS minutes FROM clicks c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts >= s.sold_at""")
def asof_sale_of_click(spark, sf_dir):
    """For every click the latest sale of its client at or before it; one client may hold a third of both tables."""
    sales = table(spark, sf_dir, "sales").select("client_id", "sale_id", "sold_at")
    found = temporal.as_of(table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), sales, ["client_id"], "ts", "sold_at", "sale_id")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - F.floor(F.unix_micros(F.col("match.sold_at").cast("timestamp")) / 1_000_000)
    return found.select("click_id", "client_id", F.col("match.sale_id").alias("sale_id"), F.floor(seconds / 60).alias("minutes"))


@query(f"""WITH {_SALES.format('min')} SELECT click_id, CASE WHEN sold_at - ts <= INTERVAL 6 HOURS THEN sale_id END AS sale_id FROM clicks c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts < s.sold_at""")
def asof_next_sale(spark, sf_dir):
    """For every click the earliest sale of its client after it, if within six hours."""
    sales = table(spark, sf_dir, "sales").select("client_id", "sale_id", "sold_at")
    found = temporal.as_of(table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), sales, ["client_id"], "ts", "sold_at", "sale_id", forward=True, equal=False, within="6 hours")
    return found.select("click_id", F.col("match.sale_id").alias("sale_id"))


_SESSIONS = """steps AS (SELECT client_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY client_id ORDER BY ts, click_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM clicks WHERE ts IS NOT NULL),
runs AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM steps),
sessions AS (SELECT client_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM runs GROUP BY client_id, run)"""


def _click_sessions(spark, sf_dir):
    return temporal.sessions(table(spark, sf_dir, "clicks").select("client_id", "ts", "click_id"), "client_id", "ts", "30 minutes", "click_id")


@query(f"WITH {_SESSIONS} SELECT client_id, started, ended, n FROM sessions")
def click_sessions(spark, sf_dir):
    return _click_sessions(spark, sf_dir)


@query(f"""WITH {_SESSIONS} SELECT s.client_id, started, n, sale_id, sold_at FROM sessions s JOIN sales o ON s.client_id = o.client_id AND started <= sold_at + INTERVAL 2 HOURS AND sold_at <= ended""")
def session_overlaps(spark, sf_dir):
    """Sessions of clients and the two hours from their sales on, where they overlap."""
    sales = table(spark, sf_dir, "sales").select("client_id", "sale_id", "sold_at", (F.col("sold_at") + F.expr("INTERVAL 2 HOURS")).alias("until"))
    pairs = temporal.overlaps(_click_sessions(spark, sf_dir), sales, ["client_id"], ("started", "ended"), ("sold_at", "until"))
    return pairs.select("l.client_id", "l.started", "l.n", "r.sale_id", "r.sold_at")


@query("SELECT item_id, vendor_id, price FROM items JOIN vendors ON price >= balance AND price <= balance + 25 WHERE NOT isnan(price) AND NOT isnan(balance)")
def prices_in_reach(spark, sf_dir):
    """Items whose price a vendor's balance comes to, give or take: points in ranges, without a key."""
    items = table(spark, sf_dir, "items").select("item_id", "price")
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", "balance", (F.col("balance") + 25).alias("most"))
    pairs = temporal.overlaps(items, vendors, [], ("price", "price"), ("balance", "most"), 25.0)
    return pairs.select("l.item_id", "r.vendor_id", "l.price")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))


_BY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
_ORDER = ", ".join(_BY)


@query(f"SELECT l_orderkey, l_linenumber, sum(l_extendedprice::DECIMAL(18,2)) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS revenue, row_number() OVER (ORDER BY {_ORDER}) AS n FROM lineitem")
def running_revenue(spark, sf_dir):
    """Revenue of all line items up to each, in the order of shipping; no task sees the whole order."""
    rows = ordered.running(_lines(spark, sf_dir), [F.col(c) for c in _BY], {"revenue": F.col("price"), "n": F.lit(1)})
    return rows.select("l_orderkey", "l_linenumber", "revenue", "n")


@query(f"SELECT l_orderkey, l_linenumber, ntile(100) OVER (ORDER BY {_ORDER}) AS tile FROM lineitem")
def shipping_percentiles(spark, sf_dir):
    """Line items in hundred equal runs of the order of shipping."""
    return ordered.tiled(_lines(spark, sf_dir), [F.col(c) for c in _BY], 100).select("l_orderkey", "l_linenumber", "tile")


@query(f"""SELECT l_orderkey, l_linenumber, lag(l_orderkey, 2) OVER w AS second_before, lead(l_orderkey) OVER w AS next,
  sum(l_extendedprice::DECIMAL(18,2)) OVER (ORDER BY {_ORDER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS seven FROM lineitem WINDOW w AS (ORDER BY {_ORDER})""")
def shipping_neighbours(spark, sf_dir):
    """Neighbours and the sum of seven line items in the order of shipping."""
    columns = {"second_before": lambda w, f: F.lag("l_orderkey", 2).over(w), "next": lambda w, f: F.lead("l_orderkey").over(w), "seven": lambda w, f: F.sum("price").over(w.rowsBetween(-6, 0))}
    rows = ordered.framed(_lines(spark, sf_dir), [F.col(c) for c in _BY], 6, 1, columns)
    return rows.select("l_orderkey", "l_linenumber", "second_before", "next", "seven")


_SOLD = "sold_at NULLS FIRST, sale_id NULLS FIRST, total NULLS FIRST, arrived_at NULLS FIRST"


@query(f"SELECT client_id, sale_id, sum(total::DECIMAL(18,2)) OVER (PARTITION BY client_id ORDER BY {_SOLD} ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY client_id ORDER BY {_SOLD}) AS nth FROM sales")
def running_spend(spark, sf_dir):
    """What each client has spent up to each sale; the null client is one."""
    order = [F.col(c) for c in ("sold_at", "sale_id", "total", "arrived_at")]
    rows = ordered.running(table(spark, sf_dir, "sales"), order, {"spent": F.col("total").cast("decimal(18,2)"), "nth": F.lit(1)}, ["client_id"])
    return rows.select("client_id", "sale_id", "spent", "nth")


@query("SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS fraction, round(unnest(quantile_cont(total, [0.01, 0.25, 0.5, 0.75, 0.99])), 6) AS value FROM sales WHERE total IS NOT NULL AND NOT isnan(total)")
def sale_quantiles(spark, sf_dir):
    """Exact quantiles of the totals of sales."""
    found = ordered.quantiles(table(spark, sf_dir, "sales").where("NOT isnan(total)"), "total", [0.01, 0.25, 0.5, 0.75, 0.99])
    return found.select("fraction", F.round("value", 6).alias("value"))
