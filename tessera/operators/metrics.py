"""Phase metrics in long form: totals, rates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the order of phases.
PHASES = ("followup", "fixup", "discovery", "extract", "fetch", "parse")


def rate(items: Column, seconds: Column) -> Column:
    """Items a second; 0 without duration."""
    return F.when(seconds > 0, items / seconds).otherwise(F.lit(0.0))


def average_missing(missing: Column, successes: Column) -> Column:
    return F.when(successes > 0, missing / successes).otherwise(F.lit(0.0))


def repair_rate(fixed: Column, attempted: Column) -> Column:
    """Percent repaired; 100 if nothing was tried."""
    return F.when(attempted > 0, fixed * 100.0 / attempted).otherwise(F.lit(100.0))


def totals(metrics: DataFrame) -> DataFrame:
    """Sums over phases of the metrics that may be added, if there are at least two phases."""
    added = metrics.where("overlappable").groupBy("metric").agg(F.sum("value").alias("total"), F.count_distinct("phase").alias("phases"))
    several = metrics.agg(F.count_distinct("phase").alias("k"))
    return added.crossJoin(F.broadcast(several)).where("k >= 2").drop("k")  # several is one row


def per_phase(metrics: DataFrame) -> DataFrame:
    """The other metrics by phase, where not zero."""
    rows = metrics.where("NOT overlappable AND value <> 0")
    return rows.groupBy("metric").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "value")))).alias("by_phase"))


def in_order(rows: DataFrame, phase: str = "phase") -> DataFrame:
    """By the position of the phase in the pipeline; unknown ones last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col(phase)), F.lit(0)), F.lit(len(PHASES) + 1))
    return rows.withColumn("position", place).orderBy("position", phase)


def outcome_counts(rows: DataFrame, group: str, name: str = "name") -> DataFrame:
    """Successes and failures (a name is there and is not Unknown)."""
    good = F.coalesce(F.col(name), F.lit("Unknown")) != "Unknown"
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def bytes_downloaded(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.agg(F.coalesce(F.sum(F.octet_length(html)), F.lit(0)).alias("bytes"))


def failed_urls(rows: DataFrame, url: str, shown: int = 20) -> DataFrame:
    """The first failed urls and how many more there are."""
    more = rows.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return rows.orderBy(url).limit(shown).select(url).crossJoin(F.broadcast(more))  # more is one row


def latest_bar(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max_by(F.struct(*bars.columns), F.struct("last_update", "created_at")).alias("bar")).select("bar.*")
