"""Analytics rows: typing, rank, key figures, skills, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import decimal_of, integer_of, list_of, minutes_of, number_or_zero
from ..schemas import NUMERIC
from .ordered import numbered, quantiles

TABLE_COLUMNS = (
    "rank", "name", "title", "success_score", "completion_rate", "ontime_delivery_rate", "rehire_rate", "communication_success_rate", "total_completed_projects", "avg_response_time_minutes", "skills_str", "profile_url")


def existing(rows: DataFrame, columns) -> DataFrame:
    """Those of the columns that there are."""
    return rows.select([c for c in columns if c in rows.columns])


def gold(profiles: DataFrame, score: Column | None = None) -> DataFrame:
    """Flat typed analytics rows from profiles: percentages, counts, minutes. The score is the caller's."""
    stat = lambda name: F.try_element_at("stats", F.lit(name))
    rates = {c: decimal_of(stat(c)) for c in ("employment_rate", "completion_rate", "ontime_delivery_rate", "rehire_rate", "communication_success_rate", "financial_deals")}
    counts = {c: integer_of(stat(c)) for c in ("received_projects", "total_completed_projects", "active_projects")}
    out = profiles.withColumns(rates | counts | {"avg_response_time_minutes": minutes_of(stat("avg_response_time_raw")), "skills_count": F.size(F.coalesce("skills", F.array().cast("array<string>")))})
    return out if score is None else out.withColumn("success_score", score)


def typed(rows: DataFrame) -> DataFrame:
    """Numbers (0 where absent or bad) and skills as a list."""
    columns = dict(rows.dtypes)
    out = rows.withColumns({c: number_or_zero(F.col(c)) if c in columns else F.lit(0.0) for c in NUMERIC})
    if columns.get("skills") == "string":
        out = out.withColumn("skills", list_of(F.col("skills")))
    elif "skills" not in columns:
        out = out.withColumn("skills", F.array().cast("array<string>"))
    return out


def ranked(rows: DataFrame, score: str = "success_score", tie: str = "profile_url", parts: int | None = None) -> DataFrame:
    """1-based rank by score, ties by the key; null scores come last, in the order of the key. No task sees the whole order."""
    return numbered(rows, [F.desc_nulls_last(score), F.asc_nulls_first(tie)], name="rank", parts=parts)


def top(rows: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    """The best n: each task keeps n rows, so the whole order is never made."""
    return rows.orderBy(F.desc(score), tie).limit(n)


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when((score >= 60) & (score < 80), "middle").when(score < 40, "low")


def completion_band(rate: Column) -> Column:
    return F.when(rate >= 95, "high").when(rate < 70, "low")


def ontime_band(rate: Column) -> Column:
    return F.when(rate >= 80, "high").when(rate < 50, "low")


def table_rows(rows: DataFrame) -> DataFrame:
    """The columns of the table, skills as text, with bands and odd rows marked."""
    out = rows.withColumn("skills_str", F.array_join("skills", ", "))
    return existing(out, TABLE_COLUMNS).withColumns({
        "score_band": score_band(F.col("success_score")), "completion_band": completion_band(F.col("completion_rate")), "ontime_band": ontime_band(F.col("ontime_delivery_rate")), "odd": F.col("rank") % 2 == 1})


def display_name(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.coalesce("name", "profile_url"))


def key_figures(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("success_score").alias("best_score"), F.avg("completion_rate").alias("mean_completion"), F.count("*").alias("n_rows"))


def exploded(rows: DataFrame, order: str, skills: str = "skills") -> DataFrame:
    """One row per skill with a place that tells what was met first."""
    return rows.select("*", F.posexplode(skills).alias("_pos", "skill")).withColumn("place", F.struct(order, "_pos")).drop("_pos")


def frequent(skills: DataFrame, n: int, name: str = "skill") -> DataFrame:
    """The n most frequent skills; ties to the one met first."""
    return skills.groupBy(name).agg(F.count("*").alias("n"), F.min("place").alias("met")).orderBy(F.desc("n"), "met").limit(n).drop("met")


def skill_rates(skills: DataFrame, n: int = 20) -> DataFrame:
    """Means and counts of the n most frequent skills (ties to the one met first), worst completion first."""
    found = skills.groupBy("skill").agg((F.sum("completion_rate") / F.count("completion_rate")).cast("double").alias("mean_completion"), (F.sum("success_score").cast("double") / F.count("success_score")).alias("mean_score"), F.count("*").alias("n"), F.min("place").alias("met"))
    return found.orderBy(F.desc("n"), "met").limit(n).drop("met").orderBy("mean_completion", "skill")


def histogram(rows: DataFrame, column: str, bins: int, positive: bool = True) -> DataFrame:
    """Counts per bin of equal width between the least and the largest value; the last bin is closed."""
    values = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    values = values.where("x > 0") if positive else values
    ends = values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    joined = values.crossJoin(F.broadcast(ends))  # ends is one row
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return joined.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """Five numbers, mean and deviation. Quartiles are exact, from the numbered order; with an ``accuracy`` they are sketched."""
    x = F.col(column)
    rest = [F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev(x).alias("deviation")]
    if accuracy is not None:
        q = F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(accuracy))
        return rows.agg(*rest, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    at = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles(rows, column, list(at.values())).agg(*[F.max(F.when(F.col("fraction") == f, F.col("value"))).alias(n) for n, f in at.items()])
    return rows.agg(*rest).crossJoin(found)  # one row each


def bubbles(rows: DataFrame, size: str) -> DataFrame:
    return rows.withColumn("bubble", F.sqrt(F.greatest(F.col(size).cast("double"), F.lit(1.0))) * 4)


def categories(rows: DataFrame) -> DataFrame:
    """Rows of each category; none for the category of rows without one."""
    return rows.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
