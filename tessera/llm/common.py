"""Shared pieces of the corpus operators: shared-folder tables, Arrow slices, word and hash arrays.

Everything here works on one Arrow slice of bounded size at a time (``SLICE_BYTES`` of text, or a
single text if that one is longer); nothing gathers the corpus.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

SLICE_BYTES = 1 << 19
_MASK = (1 << 64) - 1
#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2^64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (BYTE_BASE, WORD_BASE)}
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- tables

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where unset and in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files of the write go when it has ended.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later result reads."""
    for table_ in tables:
        path = table_.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table_.written_to)
        path.getFileSystem(table_.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def others(columns: Iterable[str], *taken: str) -> list[str]:
    """The columns whose names do not clash with ``taken``; names are compared as Spark does, without case."""
    names = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in names]


def tasks(total: int, each: int) -> int:
    """Tasks for ``total``, of which one takes ``each``; beyond 20000 tasks up to 32 times as much (they stream what they get)."""
    many = -(-total // each)
    return max(1, min(many, max(20_000, many // 32)))


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many signs added as it takes to clash with none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text") -> F.Column:
    """A hash of the text: with the id it tells rows apart that share an id but not a text."""
    return F.xxhash64(F.col(text))


def give_back() -> None:
    """Return memory that this process has freed to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps the memory for the next use


# ---------------------------------------------------------------- Arrow

#: What operators keep in a Python worker from task to task, by operator.
worker_tables: dict[str, dict] = {}


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most ``limit`` bytes of ``text`` (a longer text comes alone).

    A worker that goes on to another operator lets go of what operators other than ``keep`` have kept.
    """
    for owner, kept in worker_tables.items():
        if owner != keep:
            kept.clear()
    for batch in batches:
        col = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()  # workers are kept for the next task, which may be another operator's


def raw_texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def shrunk(docs: DataFrame, text: str = "text") -> DataFrame:
    """The text packed (Zstandard) for a shuffle; ``grown`` unpacks it. Null stays null."""
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        for part in slices(batches, text):
            packed = [None if t is None else len(t).to_bytes(8, "little") + (pa.compress(t, "zstd", asbytes=True) if t else b"") for t in part.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(packed, pa.binary())], names=[*rest, text])

    fields = [docs.schema[c] for c in rest]
    return docs.select(*rest, text).mapInArrow(run, StructType([*fields, StructField(text, BinaryType())]))


def grown(packed: bytes | None) -> bytes:
    if packed is None:
        return b""
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""


def packed_slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in runs of at most ``limit`` bytes of unpacked text, with those texts."""
    for batch in slices(batches, text, 1 << 62):
        start, size, held = 0, 0, []
        for row, packed in enumerate(batch.column(text)):
            raw = grown(packed.as_py())
            if held and size + len(raw) > limit:
                yield batch.slice(start, len(held)), held
                start, size, held = row, 0, []
            held.append(raw)
            size += len(raw)
        if held:
            yield batch.slice(start, len(held)), held


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], starts[i]+1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Arrow binaries of the given sizes from their bytes one after the other."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if ends[-1] >> 31:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# ---------------------------------------------------------------- hashes

def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of polynomial hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums from which ``span_of`` takes the hash of any span."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return total


def span_of(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix((total[ends] - total[starts]) * powers(_INVERSE[base], len(total))[starts])


def word_table(stops: Iterable[int]) -> np.ndarray:
    """True for bytes that belong to words."""
    out = np.ones(256, bool)
    out[list(stops)] = False
    return out


#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ as sets of bytes that end them.
SPACES = word_table([0x20, *range(0x09, 0x0E)])
PLAIN = word_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Words:
    """Word spans and hashes of the texts of one slice; texts are kept apart by a line feed."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()
        self.data = joined
        self.bytes = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero(np.diff(inside[self.bytes].view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        self.text_starts = np.concatenate(([0], np.cumsum(sizes)))
        #: first[d] .. first[d + 1] are the words of text d.
        self.first = np.searchsorted(self.starts, self.text_starts)
        self._total: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes."""
        if self._total is None:
            self._total = running(self.bytes.astype(np.uint64) + np.uint64(1), BYTE_BASE)
        return span_of(self._total, starts, ends, BYTE_BASE)

    def forget(self) -> None:
        """Let go of what only saves time."""
        self._total = None

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def of(self, d: int) -> list[bytes]:
        data, a, b = self.data, self.first[d], self.first[d + 1]
        return [data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean array of n cells: True inside any of the half-open spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
