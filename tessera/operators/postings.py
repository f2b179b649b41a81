"""Literal search by an index of trigrams with their places.

Texts are indexed in runs of some million characters, in the task that reads them, so nothing is shuffled to build
the index. A posting is (trigram, run, its places in the run's texts, laid end to end); of the places the distances
are kept, in as few bytes as each takes. One more row of each run tells its texts' keys and ends. Postings lie in
partitions by the trigram's hash, sorted by trigram, so a query reads the partitions of its own trigrams and, by the
pages' statistics, little else. Per run the places of all trigrams are shifted by their place in the query and
intersected: what is left are the places where the query stands, without a look at any text. A frequent trigram is
a posting in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
#: Characters of a run (its last text may be longer than what is left), and its texts at most.
RUN, MOST = 1 << 22, 1 << 16
#: Rows of a page, which is what a query reads at least.
PAGE = 128
#: Partition and trigram of the rows that tell a run's texts.
_TEXTS = -1
#: Bits of a code point in a trigram's number.
_BITS = 21


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _numbers(c: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Trigrams of code points as numbers."""
    return (c[:-2] << 2 * bits) | (c[1:-1] << bits) | c[2:] if len(c) > 2 else np.empty(0, np.int64)


def _bucket(gram, buckets: int):
    return F.when(gram == _TEXTS, F.lit(_TEXTS)).otherwise(F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int"))


def _sorted(c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different trigrams of texts laid end to end, in order, where each begins in the list of places, and that list."""
    used = np.zeros(1 << _BITS, bool)
    used[c] = True
    signs = np.flatnonzero(used)
    bits, low = len(signs).bit_length(), len(c).bit_length()
    grams = _numbers((np.cumsum(used) - 1)[c], bits)  # by their ranks code points are shorter
    inside = np.ones(len(c), bool)
    inside[ends[ends > 0] - 1] = False
    inside[ends[ends > 1] - 2] = False
    places = np.flatnonzero(inside[:len(grams)])
    grams = grams[places]
    if 3 * bits + low < 64:
        both = (grams << low) | places
        both.sort()
        grams, places = both >> low, both & ((1 << low) - 1)
    else:
        order = np.argsort(grams, kind="stable")
        grams, places = grams[order], places[order]
    heads = np.flatnonzero(np.diff(grams, prepend=-1))
    found, mask = grams[heads], (1 << bits) - 1
    return (signs[found >> 2 * bits] << 2 * _BITS) | (signs[(found >> bits) & mask] << _BITS) | signs[found & mask], heads, places


def _packed(places: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Ascending places from each head on, as distances: seven bits a byte, low ones first, and a sign that more follow."""
    steps = np.diff(places, prepend=0)
    steps[heads] = places[heads]
    sizes = 1 + sum((steps >= 1 << 7 * k).astype(np.int8) for k in range(1, 5))
    ends = np.cumsum(sizes, dtype=np.int64)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    at = ends - sizes
    for k in range(5):
        more = sizes > k
        data[at[more] + k] = ((steps[more] >> 7 * k) & 127) | ((sizes[more] > k + 1) * 128)
    bounds = np.append(at[heads], len(data))
    if bounds[-1] >> 31:
        raise ValueError("a text of more than a thousand million characters is not indexed")
    return pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(packed: bytes) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    steps = np.zeros(len(last), np.int64)
    for k in range(5):
        more = last - first >= k
        steps[more] |= (data[first[more] + k] & 127).astype(np.int64) << 7 * k
    return np.cumsum(steps)


def laid(rows: DataFrame, key: str, text: str, buckets: int = BUCKETS, each: int = RUN) -> DataFrame:
    """The index's rows: (run, gram, places), and per run (run, -1, keys, ends) of its texts. Null and short texts have no postings."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        texts: list[str] = []
        keys: list[pa.Array] = []

        def close() -> Iterator[pa.RecordBatch]:
            ends = np.cumsum([len(t) for t in texts])
            grams, heads, places = _sorted(_points("".join(texts)), ends)
            name, n, listed = (part << 32) + number, len(heads), pa.concat_arrays(keys)
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            none = [pa.nulls(n, pa.list_(listed.type)), pa.nulls(n, pa.list_(pa.int32()))]
            names = ["run", "gram", "places", "keys", "ends"]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_TEXTS]), pa.nulls(1, pa.binary()), lists(listed), lists(pa.array(ends, pa.int32()))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(grams), _packed(places, heads), *none], names=names)

        for batch in batches:
            size, first = sum(map(len, texts)), 0
            for row in range(batch.num_rows):
                texts.append(batch.column(1)[row].as_py() or "")
                size += len(texts[-1])
                if size >= each or len(texts) == MOST:
                    keys.append(batch.column(0).slice(first, row + 1 - first))
                    yield from close()
                    texts, keys, size, first, number = [], [], 0, row + 1, number + 1
            if first < batch.num_rows:
                keys.append(batch.column(0).slice(first))
        if texts:
            yield from close()

    found = rows.select(key, text).mapInArrow(run, f"run long, gram long, places binary, keys array<{kind}>, ends array<int>")
    return found.withColumn("bucket", _bucket(F.col("gram"), buckets)).sortWithinPartitions("bucket", "gram")


def build(rows: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS, each: int = RUN) -> None:
    """Write the index of a column. Each task writes what it has read; pages are short and packed well."""
    laid(rows, key, text, buckets, each).write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE).partitionBy("bucket").parquet(path)


def hits(index: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, first, n): a row per text that holds the query, its first place and how often it stands there.

    ``index``: the written table. Queries of fewer than three characters have no trigram and are refused.
    """
    grams = _numbers(_points(query)).tolist()
    if not grams:
        raise ValueError("the index answers queries of three characters or more")
    offsets: dict[int, list[int]] = {}
    for offset, gram in enumerate(grams):
        offsets.setdefault(gram, []).append(offset)
    where = index.sparkSession.createDataFrame([(g,) for g in offsets], "gram long").select(_bucket(F.col("gram"), buckets).alias("b")).distinct()
    read = index.where(F.col("bucket").isin([r.b for r in where.collect()]) & F.col("gram").isin(list(offsets))).drop("keys", "ends")  # as many as the query has trigrams
    texts = index.where(F.col("bucket") == _TEXTS).drop("places")

    def found(rows: pa.Table) -> pa.Table:
        lists = {g: p for g, p in zip(rows["gram"].to_pylist(), rows["places"], strict=True) if g != _TEXTS}
        own = rows.filter(pa.array([g == _TEXTS for g in rows["gram"].to_pylist()]))
        keys, ends = (own[c].combine_chunks().flatten() for c in ("keys", "ends"))
        starts = np.empty(0, np.int64)
        if len(lists) == len(offsets):
            starts = None
            for gram, at in offsets.items():
                places = _unpacked(lists[gram].as_py())
                for o in at:
                    starts = places - o if starts is None else np.intersect1d(starts, places - o, assume_unique=True)
        stops = np.asarray(ends, np.int64)
        text, at, n = np.unique(np.searchsorted(stops, starts, "right"), return_index=True, return_counts=True)
        first = starts[at] - np.append(0, stops)[text]
        return pa.table({"key": keys.take(pa.array(text)), "first": pa.array(first, pa.int32()), "n": pa.array(n, pa.int32())})

    kind = index.schema["keys"].dataType.elementType.simpleString()
    return read.unionByName(texts, allowMissingColumns=True).groupBy("run").applyInArrow(found, f"key {kind}, first int, n int")


def search(index: DataFrame, rows: DataFrame, key: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows that hold the query, with ``score`` as a scan of their texts gives it: 1000 less the first place."""
    found = hits(index, query, buckets).select(F.col("key").alias("_key"), (1000 - F.col("first")).cast("long").alias("score"))
    return rows.join(found, F.col(key) == F.col("_key")).drop("_key")
