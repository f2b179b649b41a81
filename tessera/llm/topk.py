"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors become integers, floor(1024 x). Rows are taken in blocks; a block keeps one sorted list per
dimension. For a query, lists are read from their good end (the sign of the weight tells which), a step
of depth at a time; unseen rows are scored in full; reading stops when the bound, the score a row could
have whose components all equal the values at the present depth, is below the k-th score so far (equal
scores must still be read: ties go to the smaller id). The k-th score is carried from block to block.

How soon reading stops depends on the data: with few dimensions, or a few that decide, most rows are never
scored (``Best.scored`` counts them); of vectors that point anywhere in many dimensions, as good as all
are read before the bound falls below the k-th score.

Queries are broadcast in blocks of ``QUERIES`` rows, each with one pass over the rows; every task gives
its k best per query, and the best of those are kept (a task sends no more than k rows per query on).

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows with a null id; a shorter vector counts as ending in zeros; equal rows are all candidates; a query
is no candidate of its own (by id). Integer scores must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
QUERIES = 8192
BLOCK = 8192
STEP = 16


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column, padded with zeros to one width."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes) and (sizes == width).all():
        return flat[ends[0]:ends[-1]].reshape(len(sizes), width).astype(np.int64)
    for r, size in enumerate(sizes.tolist()):
        take = min(size, width)
        out[r, :take] = flat[ends[r]:ends[r] + take]
    return out


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, ids, k
        self.scored = 0
        self.kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        had = self.kept[q]
        scores, ids = np.concatenate((had[0], scores)), np.concatenate((had[1], ids))
        order = np.lexsort((ids, -scores))[:self.k]
        self.kept[q] = scores[order], ids[order]

    def block(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Fagin's algorithm for every query over one block of rows."""
        n, width = rows.shape
        weights = self.queries[:, :width] if self.queries.shape[1] >= width else np.pad(self.queries, ((0, 0), (0, width - self.queries.shape[1])))
        limit = int(np.abs(rows).max(initial=0)) * int(np.abs(weights).max(initial=0)) * max(width, 1)
        kind = np.float64 if limit < 1 << 53 else np.int64  # floats are exact here, and their products faster
        rows, weights = rows.astype(kind), weights.astype(kind)
        order = np.argsort(rows, axis=0, kind="stable")
        ordered = np.take_along_axis(rows, order, axis=0)
        depths = np.arange(0, n, STEP)
        # bounds[q, s]: the most that a row can score that has not been read before depth depths[s].
        bounds = np.maximum(weights, 0) @ ordered[n - 1 - depths].T + np.minimum(weights, 0) @ ordered[depths].T
        for q, weight in enumerate(weights):
            up, down = np.flatnonzero(weight > 0), np.flatnonzero(weight < 0)
            seen = ids == self.own[q]
            for s, depth in enumerate(depths.tolist()):
                scores = self.kept[q][0]
                if len(scores) == self.k and bounds[q, s] < scores[-1]:
                    break
                stop = min(depth + STEP, n)
                if not len(up) and not len(down):
                    fresh = np.flatnonzero(~seen)  # a zero query: every row scores zero
                else:
                    read = np.zeros(n, bool)
                    read[order[n - stop:n - depth][:, up].ravel()] = True
                    read[order[depth:stop][:, down].ravel()] = True
                    fresh = np.flatnonzero(read & ~seen)
                if len(fresh):
                    seen[fresh] = True
                    self.scored += len(fresh)
                    self.add(q, (rows[fresh] @ weight).astype(np.int64), ids[fresh])
                if seen.all():
                    break

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for q, (scores, ids) in enumerate(self.kept):
            for score, i in zip(scores.tolist(), ids.tolist(), strict=True):
                yield int(self.own[q]), i, score


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the k best rows of ``vectors`` for each row of ``queries`` (both from ``integers``)."""
    spark = vectors.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // QUERIES))
    whole = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        asked = part.toArrow().combine_chunks()
        ids = asked.column("vec_id").to_numpy()
        lists = asked.column("v")
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
        held = spark.sparkContext.broadcast((matrix(lists) if len(ids) else np.zeros((0, 0), np.int64), ids))

        def run(batches, held=held):
            best = Best(*held.value, k)
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    piece = batch.slice(start, BLOCK)
                    if len(best.own):
                        best.block(piece.column("vec_id").to_numpy(), matrix(pa.array(piece.column("v"))))
            found = list(best.rows())
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        whole = found if whole is None else whole.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
