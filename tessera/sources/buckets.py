"""Tables in hash buckets whose repairs rewrite only the buckets that change.

A table is a folder with a partition per bucket of its key. ``merge`` finds the rows that a set of repairs really
changes, rewrites the buckets that hold one by dynamic partition overwrite, and leaves all other files as they are; a
second run of the same repairs writes nothing. New content is written to the shared folder before a bucket is replaced, so a
run that is lost on the way is run again with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept

BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write rows as a table in ``buckets`` parts by the hash of ``key``; null keys have a bucket too."""
    rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows with their bucket."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)


def merge(spark: SparkSession, path: str, schema, repairs: DataFrame, key: str, fields: list[str], buckets: int = BUCKETS, insert: bool = True) -> dict:
    """Set ``fields`` of the rows with a repair of their key; with ``insert`` keys that are new are added.

    A repair's null field leaves what is there. Of several repairs of a key the least of their values counts; repairs of a
    null key, and repeated rows of the table, are: none, and all repaired. Returns {"changed", "added", "buckets"}.
    """
    new = repairs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*fields)).alias("_new"))
    new = kept(new.withColumn("_bucket", _bucket("_key", buckets)), "repairs")
    there = load(spark, path, schema)
    changes = F.lit(False)
    for f in fields:
        changes |= F.col(f"_new.{f}").isNotNull() & ~F.col(f"_new.{f}").eqNullSafe(F.col(f))
    looked = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
    same = (F.col(key) == F.col("_key")) & (F.col("bucket") == F.col("_bucket"))
    pairs = there.where(F.col("bucket").isin(looked)).select(key, "bucket", *[f for f in fields if f != key]).join(new, same, "right")
    kinds = pairs.select(F.col("_bucket").alias("b"), F.when(F.col("bucket").isNull(), F.lit(insert).cast("int") * 2).when(changes, 1).otherwise(0).alias("kind"))
    found = kinds.where("kind > 0").groupBy("b", "kind").agg(F.count(F.lit(1)).alias("n")).collect()  # at most two per bucket
    touched = sorted({r.b for r in found})
    if touched:
        old = there.where(F.col("bucket").isin(touched))
        both = old.join(new.where(F.col("_bucket").isin(touched)), same, "full" if insert else "left")
        values = {c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in fields else F.coalesce(F.col(c), F.col("_key")) if c == key else F.col(c) for c in schema.fieldNames()}
        rows = kept(both.select(*[v.alias(c) for c, v in values.items()], F.coalesce("bucket", "_bucket").alias("bucket")), "buckets")
        rows.hint("rebalance", "bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    count = lambda kind: sum(r.n for r in found if r.kind == kind)
    return {"changed": count(1), "added": count(2), "buckets": touched}
