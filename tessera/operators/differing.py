"""Two versions of a table compared by a tree of checksums.

Rows fall into ranges of their key's hash. Each range has its number of rows and the sum of their checksums, made
beside the scan by partial sums. Ranges that agree are done; the others are cut into finer ones, and only rows of the
finest ranges that differ are shuffled to be compared. What moves follows the differences, not the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .records import compared

#: Bits of the hash by which a level cuts; rows that a finest range should hold.
BITS, LEAF = 12, 64


def _marked(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Key, fields, the key's hash and the row's checksum (null and empty differ)."""
    told = [x for f in fields for x in (F.col(f), F.col(f).isNull())]
    return rows.where(F.col(key).isNotNull()).select(key, *fields, F.xxhash64(key).alias("_hash"), F.xxhash64(key, *told).cast("decimal(38,0)").alias("_sum"))


def _ranges(rows: DataFrame, level: int, known: DataFrame | None) -> DataFrame:
    return rows if known is None else rows.join(known.withColumnRenamed("_range", "_known"), F.shiftrightunsigned("_hash", 64 - BITS * level) == F.col("_known"), "left_semi")


def differing_ranges(stored: DataFrame, parsed: DataFrame, rows: int, most_levels: int = 4) -> tuple[DataFrame | None, int]:
    """Ranges of the finest level that differ, and that level; as many levels as ``rows`` rows need."""
    known, level = None, 0
    while level < most_levels and (level == 0 or (1 << BITS * level) * LEAF < rows):
        sides = []
        for side in (stored, parsed):
            at = F.shiftrightunsigned("_hash", 64 - BITS * (level + 1)).alias("_range")
            sides.append(_ranges(side, level, known).groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum("_sum").alias("s")))
        a, b = sides
        b = b.select(F.col("_range").alias("_other"), F.col("n").alias("m"), F.col("s").alias("t"))
        both = a.join(b, F.col("_range") == F.col("_other"), "full")
        known = kept(both.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("s").eqNullSafe(F.col("t")))).select(F.coalesce("_range", "_other").alias("_range")), "differing")
        level += 1
    return known, level


def differences(stored: DataFrame, parsed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What ``records.compared`` gives for the whole tables: (key, field, kind, stored, parsed) of cells that differ.

    Keys tell rows apart (repeated keys are compared in all pairs of their own rows); rows with a null key are left out.
    Rows of equal checksums (64 bits, and their sums and numbers) count as equal. Empty tables are allowed.
    """
    a, b = _marked(stored, key, fields), _marked(parsed, key, fields)
    known, level = differing_ranges(a, b, a.count())
    left, right = (_ranges(x, level, known).select(key, *fields) for x in (a, b))
    return compared(left, right, key, fields)
