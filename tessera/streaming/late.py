"""Late rows and joins of two streams.

A watermark drops late rows without a trace. Here a row is late if it arrived more than ``late`` after its time,
which its own two times tell: ``on_time`` rows go on, ``late_rows`` go to a table of their own, and no row is
lost or in both. An on-time row is never behind a watermark of ``late`` when rows are read in the order they arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_late(time: str, arrived: str, late: str) -> Column:
    return F.coalesce(F.col(arrived).cast("timestamp") - F.col(time).cast("timestamp") > F.expr(f"INTERVAL {late}"), F.lit(False))


def on_time(rows: DataFrame, time: str, arrived: str, late: str) -> DataFrame:
    """Rows that have a time and are not late; a null time of arrival is not late."""
    return rows.where(F.col(time).isNotNull() & ~_is_late(time, arrived, late))


def late_rows(rows: DataFrame, time: str, arrived: str, late: str) -> DataFrame:
    """The others: late, or without a time."""
    return rows.where(F.col(time).isNull() | _is_late(time, arrived, late))


def matched(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, after: str, late: str) -> DataFrame:
    """Pairs of two streams with one key where the right row comes at the left row's time or up to ``after`` later.

    Returns structs ``l`` and ``r``. Two watermarks and the condition on times bound the state: a left row is kept until no
    right row can match it any more, and the other way round. Null keys match nothing.

    Rows meet by key and bin of time, ``after`` long, so a key with many rows is neither one task nor compared with all of
    its rows: a left row stands in its own bin, a right row in its own and the one before, and a pair meets once.
    """
    width = left.sparkSession.sql(f"SELECT greatest(unix_micros(timestamp_seconds(0) + INTERVAL {after}), 1) AS n").first().n
    sides = []
    for name, rows, time in (("l", left, left_time), ("r", right, right_time)):
        at = F.col(time).cast("timestamp")
        own = F.floor(F.unix_micros(at) / F.lit(width))
        bins = F.array(own) if name == "l" else F.array(own - 1, own)
        placed = rows.select(F.struct(*rows.columns).alias(name), F.col(by).alias(f"_{name}_key"), at.alias(f"_{name}_at"), F.explode(bins).alias(f"_{name}_bin"))
        sides.append(placed.withWatermark(f"_{name}_at", late))
    near = F.expr(f"_l_key = _r_key AND _l_bin = _r_bin AND _r_at >= _l_at AND _r_at <= _l_at + INTERVAL {after}")
    return sides[0].join(sides[1], near).select("l", "r")
