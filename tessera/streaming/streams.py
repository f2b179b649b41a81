"""The record operators as Structured Streaming queries.

A bounded channel is a file source with a cap on files per batch; its end is an available-now trigger.
State is unbounded by default, as whether a key was seen is never forgotten; a watermark bounds it at
the price of forgetting.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def channel(spark: SparkSession, path: str, schema, depth: int = 100, kind: str = "parquet") -> DataFrame:
    """Rows of the files in a folder (or of one file), at most ``depth`` files a batch."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.format(kind).schema(schema).option("maxFilesPerTrigger", depth).load(path)


def seeded(spark: SparkSession, path: str, schema, streamed: bool, kind: str = "parquet", depth: int = 100) -> DataFrame:
    """The same rows at rest or as a stream; transforms apply to either."""
    return channel(spark, path, schema, depth, kind) if streamed else spark.read.schema(schema).format(kind).load(path)


def unique(rows: DataFrame, key: str, event_time: str | None = None, late: str | None = None) -> DataFrame:
    """One row per key; with a watermark, keys older than ``late`` are forgotten."""
    if event_time and late:
        return rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def first_seen(rows: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """key, first (least order value of the batch that met the key), again (rows of it since), suppressed.

    A row per key and batch that holds it; ``known`` keys are suppressed (a static table).
    """
    if known is not None:
        marks = known.select(F.col(key).alias("_known")).distinct().withColumn("suppressed", F.lit(True))
        rows = rows.join(marks, F.col(key) == F.col("_known"), "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
    else:
        rows = rows.withColumn("suppressed", F.lit(False))
    kind, order_kind = (dict(rows.dtypes)[c] for c in (key, order))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per key of an Arrow batch, so that a key with a third of the rows sends few."""
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["key", "suppressed"]).aggregate([("at", "min"), ([], "count_all")])
            yield from sums.select(["key", "at_min", "count_all", "suppressed"]).rename_columns(["key", "at", "n", "suppressed"]).to_batches()

    def step(ids: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new, (first, seen) = not state.exists, state.get if state.exists else (None, 0)
        count, least, held = 0, None, False
        for part in parts:
            if len(part):
                count += int(part["n"].sum())
                low, held = part["at"].min(), bool(part["suppressed"].iloc[0])
                least = low if least is None or low < least else least
        first = int(least) if new else first
        state.update((first, seen + count))
        yield pd.DataFrame({"key": [ids[0]], "first": [first], "again": [count - 1 if new else count], "is_new": [new and not held], "suppressed": [held]})

    few = rows.select(F.col(key).alias("key"), F.col(order).alias("at"), "suppressed").mapInArrow(combined, f"key {kind}, at {order_kind}, n long, suppressed boolean")
    shape = f"key {kind}, first long, again long, is_new boolean, suppressed boolean"
    return few.groupBy("key").applyInPandasWithState(step, shape, "first long, seen long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, event_time: str, width: str, slide: str | None = None, late: str = "10 minutes", group: str | None = None) -> DataFrame:
    """Rows per tumbling or sliding window; rows later than ``late`` are dropped from a stream."""
    timed = events.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return timed.groupBy(window, *([group] if group else [])).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, event_time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return timed.groupBy(key, F.session_window(event_time, gap)).agg(F.count("*").alias("n"))


def drained(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now into a folder, and return what it gave; nothing passes the driver.

    In append mode that is every row; in complete mode the result after the last batch.
    """
    spark, out = rows.sparkSession, f"{folder}/rows"
    if mode == "append":
        appended(rows, out, f"{folder}/checkpoint")
        return spark.read.schema(rows.schema).parquet(out)
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")  # a batch that is run again gives the same folder
        batches.append(number)

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/{max(batches)}") if batches else spark.createDataFrame([], rows.schema)


def chained(steps: dict, folder: str, depth: int = 100) -> dict:
    """Stages as streaming queries that run side by side: each appends to a table that the next one reads.

    ``steps``: name -> (transform, schema of its result); the first transform takes no rows and gives a
    stream. A consumer begins as soon as its producer has committed files, and all stop with ``guarded``.
    """
    spark, before, running = None, None, {}
    for name, (transform, schema) in steps.items():
        rows = transform() if before is None else transform(channel(spark, before[0], before[1], depth))
        spark, path = rows.sparkSession, f"{folder}/{name}"
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made)
        running[name] = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoints/{name}").outputMode("append").queryName(f"{name}-{folder.rsplit('/', 1)[-1]}").start(path)
        before = (path, schema)
    return running


def appended(rows: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Run a stream over what there is now into files; a lost executor or driver goes on from the checkpoint."""
    query = rows.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def guarded(queries: dict) -> None:
    """Wait for all queries; the first that fails stops the others and is named."""
    while any(q.isActive for q in queries.values()):
        next(q for q in queries.values() if q.isActive).awaitTermination(1)
        for name, q in queries.items():
            if q.exception() is not None:
                for other in queries.values():
                    other.stop()
                raise RuntimeError(f"stage {name} failed: {q.exception()}")
    for name, q in queries.items():
        if q.exception() is not None:
            raise RuntimeError(f"stage {name} failed: {q.exception()}")
