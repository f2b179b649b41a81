"""Frames over one whole order: numbers, running sums, neighbours, tiles and quantiles.

A window over all rows, or over a group with a third of them, would sort them in one task. Here rows are dealt
by ranges of the order into at most as many parts as the session shuffles into (``dealt``), and what the parts before
sum up to is carried into each part. Between parts go only their totals: one row per part, as at most one
group goes on from a part to the next.

``order`` has to tell rows apart where the result should not depend on chance: equal rows are numbered in any
order, and rows that are equal in all of it stay in one part. Null groups are a group; nulls in the order stand
where the order puts them. Empty tables give no rows. Names that begin with ``_`` are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Rows of a chunk in ``framed``.
CHUNK = 1 << 16


def dealt(rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Rows sorted by group and order over a written table, with their part (``_part``) and place in it (``_place``, from 0)."""
    by = [*(F.col(c) for c in within), *order]
    at = F.monotonically_increasing_id()  # number of the part << 33 | place
    ranged = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by).withColumn("_at", at)
    return kept(ranged.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), "ordered")


def carried(held: DataFrame, within: Sequence[str], totals: dict[str, Column], fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Per part, and the group that reaches into it, what the parts before it come to; rows only where there is something."""
    sums = held.groupBy("_part", *within).agg(*[v.alias(k) for k, v in totals.items()])
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = sums.select(F.col("_part").alias("_own"), *[F.col(c).alias(f"_own_{c}") for c in within], *[fold(F.col(k)).over(before).alias(k) for k in totals], F.row_number().over(Window.partitionBy(*within).orderBy("_part")).alias("_nth"))
    return found.where("_nth > 1").drop("_nth")


def _with(held: DataFrame, found: DataFrame, within: Sequence[str]) -> DataFrame:
    same = F.col("_part") == F.col("_own")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    return held.join(F.broadcast(found), same, "left").drop("_own", *[f"_own_{c}" for c in within])  # at most one row per part


def numbered(rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows with their number from 1 in the order (of their group)."""
    held = dealt(rows, order, within, parts)
    place = F.row_number().over(Window.partitionBy("_part", *within).orderBy("_place")) if within else F.col("_place") + 1
    ahead = carried(held, within, {"_ahead": F.count(F.lit(1))})
    out = _with(held.withColumn("_row", place), ahead, within)
    return out.withColumn(name, F.coalesce("_ahead", F.lit(0)) + F.col("_row")).drop("_part", "_place", "_row", "_ahead")


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Rows with running sums from the order's first row (of their group); give long or decimal values for exact ones.

    A null adds nothing; the sum is null until a value was met, as in a window.
    """
    held = dealt(rows, order, within, parts)
    own = held.withColumns({f"_v_{k}": v for k, v in sums.items()})
    ahead = carried(own, within, {f"_a_{k}": F.sum(f"_v_{k}") for k in sums})
    so_far = Window.partitionBy("_part", *within).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = _with(own.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(so_far) for k in sums}), ahead, within)
    both = {k: F.when(F.col(f"_a_{k}").isNull(), F.col(f"_s_{k}")).otherwise(F.col(f"_a_{k}") + F.coalesce(F.col(f"_s_{k}"), F.lit(0))) for k in sums}
    return out.withColumns(both).drop("_part", "_place", *[f"{p}{k}" for p in ("_v_", "_s_", "_a_") for k in sums])


def framed(rows: DataFrame, order: Sequence[Column], before: int, after: int, columns: dict[str, Callable], within: Sequence[str] = (), chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Columns over the ``before`` rows before a row, the row, and the ``after`` rows after it.

    A column is a function of (window, frame): ``lambda w, f: F.lag("x").over(w)`` looks at single rows of that
    reach, ``lambda w, f: F.avg("x").over(f)`` at all of them. Rows are cut into chunks by their number, and the
    rows that a neighbouring chunk looks at are copied into it.
    """
    if before + after >= chunk:
        raise ValueError(f"a frame of {before} + {after} rows needs chunks of more rows than {chunk}")
    n = numbered(rows, order, within, "_n", parts)
    at = F.col("_n") - 1
    low, high = F.floor(F.greatest(at - after, F.lit(0)) / chunk), F.floor((at + before) / chunk)
    copies = n.withColumn("_chunk", F.explode(F.sequence(low, high)))
    whole = Window.partitionBy(*within, "_chunk").orderBy("_n")
    frame = whole.rowsBetween(-before, after)
    return copies.withColumns({k: f(whole, frame) for k, f in columns.items()}).where(F.col("_chunk") == F.floor(at / chunk)).drop("_chunk", "_n")


def tiled(rows: DataFrame, order: Sequence[Column], tiles: int, within: Sequence[str] = (), name: str = "tile", parts: int | None = None) -> DataFrame:
    """Rows in ``tiles`` runs of the order whose sizes differ by at most one, the larger first."""
    n = numbered(rows, order, within, "_n", parts)
    sizes = rows.groupBy(*[F.col(c).alias(f"_own_{c}") for c in within]).agg(F.count(F.lit(1)).alias("_size"))
    if within:
        same = F.lit(True)
        for c in within:
            same &= F.col(c).eqNullSafe(F.col(f"_own_{c}"))
        both = n.join(sizes, same)
    else:
        both = n.crossJoin(F.broadcast(sizes))  # one row
    small, more, at = F.floor(F.col("_size") / tiles), F.col("_size") % tiles, F.col("_n") - 1
    large = more * (small + 1)  # rows in the larger tiles
    tile = F.when(at < large, F.floor(at / (small + 1))).otherwise(more + F.floor((at - large) / F.greatest(small, F.lit(1))))
    return both.withColumn(name, (tile + 1).cast("int")).drop("_n", "_size", *[f"_own_{c}" for c in within])


def quantiles(rows: DataFrame, column: str, fractions: Sequence[float], parts: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of the non-null values: one row (fraction, value) each; a null value without any.

    Values are numbered in their order; only the two beside a quantile's place are looked at. Equal values are
    counted before they are numbered, so a value that most rows share is one row.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    ends = running(counted, [F.col("x")], {"high": F.col("k")}, parts=parts)
    size = counted.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("size"))
    asked = rows.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double").crossJoin(size)  # as many rows as fractions
    at = (F.col("size") - 1) * F.col("fraction")
    asked = asked.select("fraction", at.alias("at"))
    below, above = F.floor("at") + 1, F.ceil("at") + 1
    low = F.col("high") - F.col("k") + 1
    near = ends.join(F.broadcast(asked), ((low <= below) & (F.col("high") >= below)) | ((low <= above) & (F.col("high") >= above)))
    value = lambda place: F.max(F.when((low <= place) & (F.col("high") >= place), F.col("x").cast("double")))
    found = near.groupBy("fraction", "at").agg(value(below).alias("a"), value(above).alias("b"))
    got = found.select(F.col("fraction").alias("_f"), (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))
    return asked.join(got, F.col("fraction") == F.col("_f"), "left").select("fraction", "value")
