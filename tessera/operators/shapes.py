"""Records of unknown shape: variants instead of whole-file maps.

A text column is parsed once into a variant; keys are probed (``inventory``), read with a type (``typed``) and repaired
(``as_list``) from it. Texts that are no JSON, and values that do not fit the type asked for, are null; nothing fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


def parsed(rows: DataFrame, column: str, name: str = "shape") -> DataFrame:
    """Rows with the text column's JSON as a variant; null where there is none. Repeated keys of one object are no JSON."""
    return rows.withColumn(name, F.try_parse_json(column))


def typed(rows: DataFrame, variant: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns from paths such as ``$.device.os`` or ``$.items[0].sku``, each (path, type)."""
    return rows.withColumns({name: F.try_variant_get(variant, path, kind) for name, (path, kind) in fields.items()})


def as_list(variant: Column) -> Column:
    """Texts of an array, of an array written as a text, or of a single value; null where there is nothing."""
    array = lambda v: F.try_variant_get(v, "$", "array<string>")
    text = F.try_variant_get(variant, "$", "string")
    inner = F.when(F.trim(text).startswith("["), array(F.try_parse_json(text)))
    return F.coalesce(array(variant), inner, F.when(F.trim(text) != "", F.array(text)))


_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def kind_of(variant: Column) -> Column:
    """object, array, string, number, boolean or null, by the first character of the value's JSON."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    found = F.coalesce(F.try_element_at(kinds, F.substring(F.to_json(variant), 1, 1)), F.lit("number"))
    return F.when(variant.isNotNull(), found)


def inventory(rows: DataFrame, variant: str) -> DataFrame:
    """(path, kind, n): every path of the values with what is found there; elements of arrays share ``[*]``.

    Levels are opened one after the other, as many as the deepest value has, and each is written once, so no value is
    parsed or opened again for a later level. Rows are counted per path and kind before they are shuffled; only objects and
    arrays go on to the next level. Null variants have no paths.
    """
    spark = rows.sparkSession
    level, found = rows.where(F.col(variant).isNotNull()).select(F.lit("$").alias("path"), F.col(variant).alias("v")), []
    while True:
        opened = F.when(F.col("kind").isin("object", "array"), F.col("v"))
        held = kept(level.withColumn("kind", kind_of(F.col("v"))).select("path", "kind", opened.alias("v")), "level")
        have = [tuple(r) for r in held.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).collect()]  # paths of one level, not rows
        found += have
        if not any(kind in ("object", "array") for _, kind, _ in have):
            return spark.createDataFrame(found, "path string, kind string, n long")
        name = f"level_{uuid.uuid4().hex}"
        held.where(F.col("kind").isin("object", "array")).createOrReplaceTempView(name)
        level = spark.sql(f"SELECT path || coalesce('.' || x.key, '[*]') AS path, x.value AS v FROM {name}, LATERAL variant_explode(v) AS x(pos, key, value)")
