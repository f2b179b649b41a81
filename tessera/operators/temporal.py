"""Joins by time: the row in force at a time (as-of), and intervals that overlap.

Neither compares a row with all rows of its key: an as-of join is one sorted union, an overlap join looks in
the time bins that an interval touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ordered import carried, dealt, framed, running

#: Rows of one side that a bin may hold before they are dealt over several tasks.
FULL = 1 << 16


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tie: str, forward: bool = False, equal: bool = True, within: str | None = None, parts: int | None = None) -> DataFrame:
    """Every left row with the latest right row of its key at or before its time (``forward``: the earliest at or after).

    ``by``: key columns of both sides. ``tie`` tells right rows of one key and time apart: the largest counts
    (forward: the smallest). Without ``equal`` a right row of the same time does not count. ``within``: a
    length such as ``"2 hours"``; right rows further away do not count. The right row comes as the struct ``match``,
    null where there is none. Rows with a null in the key, and left rows with a null time, find nothing; right
    rows with a null time are never found. All left rows stay, repeated ones too; empty sides are allowed.

    Both sides are sorted as one union by key and time, in ranges (``ordered.dealt``): a hot key is split by time,
    and the row in force at the end of a part is carried into the parts after it.
    """
    sign = -1 if forward else 1
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * sign
    key = F.struct(*[F.col(c) for c in by])
    whole = F.when(F.col(by[0]).isNotNull(), key) if len(by) == 1 else F.when(~F.exists(F.array(*[F.col(c).isNull() for c in by]), lambda x: x), key)
    # At one time, the side that comes first is seen by the other one.
    mine, other = (1, 0) if equal else (0, 1)
    own = left.select(whole.alias("_key"), micros(left_time).alias("_time"), F.lit(mine).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.schema).alias("_right"), F.xxhash64(*left.columns).alias("_tie"))
    rows = right.where(F.col(right_time).isNotNull()).select(whole.alias("_key"), micros(right_time).alias("_time"), F.lit(other).alias("_side"), F.lit(None).cast(left.schema).alias("_left"), F.struct(*right.columns).alias("_right"), (F.col(tie).cast("long") * sign).alias("_tie"))
    held = dealt(own.unionByName(rows.where("_key IS NOT NULL")), [F.col("_time"), F.col("_side"), F.col("_tie")], ["_key"], parts)
    last = lambda c: F.last(c, ignorenulls=True)
    before = carried(held, ["_key"], {"_before": F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_place")))}, last)
    so_far = Window.partitionBy("_part", "_key").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    found = held.withColumn("_here", last(F.col("_right")).over(so_far)).where("_left IS NOT NULL")
    same = (F.col("_part") == F.col("_own")) & (F.col("_key") == F.col("_own__key"))
    match = F.coalesce("_here", "_before")
    fits = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    if within:
        far = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {within})")
        fits &= F.abs(F.col("_time") - F.unix_micros(F.col(f"_m.{right_time}").cast("timestamp")) * sign) <= far
    joined = found.join(F.broadcast(before), same, "left").withColumn("_m", match)  # at most one row per part
    return joined.select("_left.*", F.when(fits, F.col("_m")).alias("match"))


def _at(rows: DataFrame, column: str):
    """A bound as microseconds, or as the number it is."""
    kind = rows.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    number = F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


def _bins(rows: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Rows with the bounds of their interval and its level: at it, a bin is at least as wide as the interval."""
    timed = rows.withColumns({"_low": _at(rows, start), "_high": _at(rows, end)}).where("_low <= _high")
    units = F.greatest(F.ceil((F.col("_high") - F.col("_low")) / width), F.lit(1))
    return timed.withColumn("_level", F.ceil(F.log2(units)).cast("int"))


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: str | float = "1 hour", full: int = FULL) -> DataFrame:
    """Pairs of intervals [start, end] of equal key (``by``, columns of both; may be empty) that share a moment or a number.

    Returns structs ``l`` and ``r``. Intervals with a bound or key that is null (or NaN), or an end before the start, overlap
    nothing; repeated rows pair each; moments count (an interval may have no length, so points in ranges are found as well).
    ``width``: of the narrowest bins, a length of time, or a number for numeric bounds.

    An interval has a level by its length and touches at most two bins of ``width`` * 2^level, so a very long one
    is not copied into every short bin. Pairs meet at the larger of their levels, in the bin of their first common moment,
    hence once. Levels that neither side has are not looked at. Left rows of a bin with more than ``full`` of them are
    dealt over several tasks and its right rows are copied to these.
    """
    spark = left.sparkSession
    unit = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {width}) AS n").first().n if isinstance(width, str) else float(width)
    sides = []
    for rows, (start, end) in ((left, left_span), (right, right_span)):
        for c in by:
            rows = rows.where(F.col(c).isNotNull())
        sides.append(_bins(rows.select(F.struct(*by).alias("_key") if by else F.lit(0).alias("_key"), F.struct(*rows.columns).alias("_row"), F.col(start), F.col(end)), start, end, unit).drop(start, end))
    levels = [sorted(r[0] for r in s.select("_level").distinct().collect()) for s in sides]  # at most 64 each
    if not all(levels):
        pair = left.select(F.struct(*left.columns).alias("l")).limit(0)
        return pair.crossJoin(right.select(F.struct(*right.columns).alias("r")).limit(0))
    present = sorted({*levels[0], *levels[1]})
    placed = []
    for side in sides:
        at = side.withColumn("_at", F.explode(F.filter(F.array(*[F.lit(x) for x in present]), lambda x: x >= F.col("_level"))))
        size = F.lit(unit) * F.pow(F.lit(2.0), F.col("_at")).cast("long" if isinstance(unit, int) else "double")
        bins = F.sequence(F.floor(F.col("_low") / size), F.floor(F.col("_high") / size))
        placed.append(at.select("*", F.explode(bins).alias("_bin"), size.alias("_size")))
    spots = ["_key", "_at", "_bin"]
    hot = kept(placed[0].groupBy(*spots).agg(F.ceil(F.count(F.lit(1)) / full).alias("_deals")).where("_deals > 1").select(*[F.col(c).alias(f"{c}2") for c in spots], "_deals"), "hot-bins")
    same = F.lit(True)
    for c in spots:
        same &= F.col(c) == F.col(f"{c}2")
    a, b = (p.join(hot, same, "left").drop(*[f"{c}2" for c in spots]).withColumn("_deals", F.coalesce("_deals", F.lit(1))) for p in placed)
    a = a.withColumn("_deal", F.pmod(F.xxhash64("_row", "_low"), F.col("_deals")))
    b = b.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)))
    b = b.select(*[F.col(c).alias(f"r{c}") for c in (*spots, "_deal", "_row", "_low", "_high", "_level")])
    meet = F.col("_deal") == F.col("r_deal")
    for c in spots:
        meet &= F.col(c) == F.col(f"r{c}")
    first = F.greatest("_low", "r_low")
    meet &= (first <= F.least("_high", "r_high")) & (F.col("_at") == F.greatest("_level", "r_level")) & (F.col("_bin") == F.floor(first / F.col("_size")))
    return a.join(b, meet).select(F.col("_row").alias("l"), F.col("r_row").alias("r"))


def sessions(rows: DataFrame, by: str, time: str, gap: str, tie: str, parts: int | None = None) -> DataFrame:
    """Runs of rows of a key whose neighbours are less than ``gap`` apart: (key, started, ended, n).

    Rows without a time belong to none; a null key is a key. ``tie`` orders rows of one time. A row begins a run
    if the row before it is too far away (its neighbour may lie in another part), and runs are numbered by a carried
    sum, so a key with a third of the rows is worked on by as many tasks as its rows take.
    """
    timed = rows.where(F.col(time).isNotNull()).select(by, F.col(time), F.col(tie).alias("_order"))
    order = [F.col(time), F.col("_order")]
    beside = framed(timed, order, 1, 0, {"_last": lambda w, f: F.lag(time).over(w)}, [by], parts=parts)
    new = F.when(F.col(time) - F.col("_last") < F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    # Of rows that are equal in the whole order the one that begins a run stands first again.
    begun = beside.withColumn("_new", F.when(F.col("_last").isNull(), 1).otherwise(new))
    marked = running(begun, [F.col(time), F.desc("_new")], {"_run": F.col("_new")}, [by], parts=parts)
    return marked.groupBy(by, "_run").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("n")).drop("_run")
