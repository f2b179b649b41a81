"""Mergeable aggregates: a row of sketches per day, stored, and rolled up to any coarser groups without the rows.

Distinct values are a HyperLogLog sketch (``LG_K``), quantiles a KLL sketch (``KLL_K``), frequent values a frequent-items
sketch of ``TRACKED`` items. Every sketch has a bound of its own, so a stored day is a row of some kilobytes
per group however many rows it had, days are merged in any order, and a late day is one more row. Bounds of the
answers: ``distinct_error`` and ``rank_error`` as shares (at three deviations and at 99 %), ``count_error`` of the rows.

Null keys are a group; null values are in no sketch; a group without values has estimates of 0 and null; rows without
a time belong to the null day. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K, TRACKED = 12, 400, 4096
#: Three standard errors of 2^12 registers; normalised rank error of a KLL sketch of 400; share of rows of a counter.
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0075, 4 / TRACKED


def daily(rows: DataFrame, time: str, keys: Sequence[str], distinct: str, value: str, item: str) -> DataFrame:
    """A row per day and keys: ``n`` and the sketches of different values, of a number's distribution and of frequent items."""
    kept = rows.select(F.to_date(time).alias("day"), *keys, F.col(distinct).alias("_d"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_v"), F.col(item).alias("_i"))
    return kept.groupBy("day", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_d", F.lit(LG_K)).alias("distinct"), F.kll_sketch_agg_double("_v", F.lit(KLL_K)).alias("values"), F.expr(f"approx_top_k_accumulate(_i, {TRACKED})").alias("items"))


def stored(days: DataFrame, path: str) -> None:
    """Write days as partitions of a table; days that are there already are replaced, the others stay."""
    days.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)


_MERGED = {
    "n": F.sum, "distinct": F.hll_union_agg, "values": F.kll_merge_agg_double, "items": lambda c: F.expr(f"approx_top_k_combine({c}, {TRACKED})")}


def rolled(days: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Sketches of every prefix of the groups ``by`` (rollup), with ``level``: 0 for all of them, then one bit more per group left out."""
    return days.rollup(*by).agg(F.grouping_id().alias("level"), *[f(c).alias(c) for c, f in _MERGED.items()])


def answers(sketches: DataFrame, fractions: Sequence[float] = (0.5,), k: int = 10) -> DataFrame:
    """The sketches' columns as estimates: different values, quantiles and the ``k`` most frequent items with counts."""
    at = F.array(*[F.lit(float(f)) for f in fractions])
    quantiles = F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", at))
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("distinct"), "values": quantiles, "items": F.expr(f"approx_top_k_estimate(items, {int(k)})")})
