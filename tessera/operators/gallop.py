"""Page counts of all labels at once by doubling and halving: a recursive query over the pages that exist."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Levels of a recursion; doubling to and halving from 2^40 pages takes 82.
LEVELS = 100


def last_pages(pages: DataFrame, labels: DataFrame, start: int = 8, most: int = 1 << 40) -> DataFrame:
    """(label, last_page): how far pages 1, 2, ... of a label go without a gap that the search meets; 0 without page 1.

    ``pages``: (label, page) of pages that exist; ``labels``: those to search. Each level of the recursion asks one page of
    every label that is still searched: ``start``, twice that, ... while they exist, then the middle of what is left. Pages
    have to be without gaps for the result to be the last one. Pages over ``most`` are not asked. Null labels and repeated
    labels and pages count once; an empty table of labels gives no rows.
    """
    spark = pages.sparkSession
    names = [f"gallop_{uuid.uuid4().hex}" for _ in range(2)]
    # Written once: every level of the recursion reads it. Dealt before repeats go, so no task gathers all pages that it makes.
    asked = pages.where("page IS NOT NULL AND label IS NOT NULL").select("label", F.col("page").cast("long").alias("page"))
    there = kept(asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "page").distinct(), "pages")
    there.createOrReplaceTempView(names[0])
    labels.select("label").distinct().createOrReplaceTempView(names[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")}
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(LEVELS))
    try:
        # low exists (0: nothing asked yet), high does not (null: not met yet); probe is asked next, null at the end.
        found = spark.sql(f"""
WITH RECURSIVE search(label, low, high, probe) AS (
  SELECT label, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(1 AS BIGINT) FROM {names[1]}
  UNION ALL
  SELECT label, low, high, CASE WHEN high IS NULL AND low >= {most} THEN NULL WHEN high IS NULL THEN least(greatest(low * 2, {start}), {most}) WHEN high - low > 1 THEN (low + high) DIV 2 END
  FROM (SELECT s.label, CASE WHEN p.page IS NULL THEN s.low ELSE s.probe END AS low, CASE WHEN p.page IS NULL THEN s.probe ELSE s.high END AS high
        FROM search s LEFT JOIN {names[0]} p ON p.label = s.label AND p.page = s.probe WHERE s.probe IS NOT NULL))
SELECT label, max(low) AS last_page FROM search GROUP BY label""")
        return kept(found, "last-pages")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in names:
            spark.catalog.dropTempView(name)
