"""Connected components of a link table by alternating stars; nothing is gathered in one place.

Each round replaces every link by one to the least neighbour (first for larger, then for smaller
neighbours), so that components become stars in a logarithmic number of rounds. A vertex with very
many links costs one pre-aggregated minimum and a join whose large side Spark may split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _least(links: DataFrame, name: str) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias(name))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "m").select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links, "m")
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links, u <> v, as longs -> (node, root): every linked node and the least node it reaches."""
    links = C.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        found = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            break
        state, before = tuple(found), links
        links = C.written(_small_star(_large_star(before)), "links")
        C.forget(before)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Least member of each of n nodes' components under links a-b, going on from ``roots``."""
    roots = np.arange(n) if roots is None else roots
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(roots, np.maximum(x, y), low)
        while (jumped := roots[roots]).tobytes() != roots.tobytes():
            roots = jumped
