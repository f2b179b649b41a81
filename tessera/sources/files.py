"""Reading and writing records: JSON, JSON lines, CSV, uploads, time-templated paths."""

from __future__ import annotations

import datetime
import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Spark's file systems is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array (or object) of records; an absent file has none."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record a line, blank lines skipped; an absent file has none."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_any_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An array of records, or an object whose first list-valued key holds them. The file is read on an executor."""
    whole = spark.read.option("wholetext", True).text(path)
    kind = whole.select(F.substring(F.ltrim("value"), 1, 1).alias("k")).first()
    if kind is None or kind.k != "{":
        return read_json(spark, path, schema)
    # Values as they stand in the text; the first that is a list gives the records.
    values = F.map_values(F.from_json("value", "map<string,string>"))
    lists = F.filter(values, lambda v: F.ltrim(v).startswith("["))
    records = F.from_json(F.try_element_at(lists, F.lit(1)), T.ArrayType(schema))
    return whole.select(F.explode(records).alias("r")).select("r.*")


def read_page_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object label -> last page as rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "label string, last_page int")
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("label", "last_page"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files by content: path, length, sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def nested_as_json(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, nulls kept."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select([F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema])


def may_write(spark: SparkSession, path: str, overwrite: bool = False) -> bool:
    """Before a run: whether its output may be written. A path that is there needs ``overwrite``."""
    if exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} is there; ask for overwrite to replace it")
    return True


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    write_json(rows, path, "append" if append else "overwrite")


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """CSV with nested values as JSON text; writes nothing for no rows. Returns whether it wrote."""
    if rows.isEmpty():
        return False
    nested_as_json(rows).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return True


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def export(rows: DataFrame, json_path: str | None = None, csv_path: str | None = None) -> None:
    """Either format, or both."""
    if json_path:
        write_json(rows, json_path)
    if csv_path:
        write_csv(rows, csv_path)


def discard(rows: DataFrame) -> int:
    """Run a plan for nothing but its count of rows."""
    from pyspark.sql import Observation

    seen = Observation("discarded")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def clean_up(spark: SparkSession, paths: list[str]) -> list[str]:
    """Delete the paths that are there; returns them."""
    gone = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True):
            gone.append(path)
    return gone


def timed_path(path: str, now: datetime.datetime | None = None) -> str:
    """Fill in {TODAY}, {DATE}, {NOW}, {TIME}, {YESTERDAY} and {HUMAN_NOW}, in any case; unknown names stay."""
    now = now or datetime.datetime.now()
    day, clock = "%Y-%m-%d", "%H%M%S"
    values = {"TODAY": now.strftime(day), "DATE": now.strftime(day), "NOW": now.strftime("%Y%m%d_" + clock), "TIME": now.strftime(clock), "YESTERDAY": (now - datetime.timedelta(days=1)).strftime(day), "HUMAN_NOW": "now"}

    def fill(m: re.Match) -> str:
        value = values.get(m[1].upper())
        if value is None:
            log.warning("no such placeholder: %s", m[0])
        return m[0] if value is None else value

    return re.sub(r"\{(\w+)\}", fill, path)
