"""Places within groups, ties included, from a bit-sliced bitmap index.

A row's pair key is the bits of its order columns one after the other (smaller first; a null comes last, by a flag
bit). Rows are dealt out by ranges of (group, a running number), so that a group's rows lie side by side in one
partition, or in as many as it takes if it is large. There the group's bitmap is a run of rows, and the index keeps per
run (an entry, of at most ``RUN`` rows) one bitmap per bit of the key, beside the rows' other columns.

The first ``places`` different keys of every group are found bit by bit, the highest first. A group's frontier is
its first prefixes that hold rows; each entry ANDs its slices along them and counts the set bits of both
continuations, the counts are summed over all entries of the group, and the first ``places`` prefixes with rows go on.
``step`` bits are descended from one exchange to the next; within it an entry keeps its own first ``places`` prefixes,
which loses nothing, as a prefix that is among the first of the group is among the first of each entry that has it.
For the same reason an entry descends its own slices once when it is made, and only stores the rows that are left.
After the last bit the frontier holds the exact keys and how many rows tie at each. Then the entries fetch the
rows whose bits spell such a key, and these are numbered (``operators.ordered``: ranges of the order with carried
counts).

Bounds: an entry sends at most ``places`` * 2^step counts; a frontier has ``places`` prefixes; what is broadcast is at
most one carried count per shuffle partition; the driver sees the least and largest value of each order column.
Frontiers reach entries by (group -> entry id) rows without slices and then by entry id, so a group with a third of
all rows is spread like any other.

Defined results: null groups are groups; equal rows are ranked separately, in any order among themselves; nulls tie
with each other; empty tables give no rows; other columns of the input are not looked at. Columns are longs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.ordered import numbered
from . import common as C

#: Rows of a block (more only where a batch is larger), and of an entry at most; bytes of bitmaps that are ANDed at once.
BLOCK, RUN, ANDED = 1 << 18, 1 << 11, 1 << 20


class Keys:
    """The layout of the pair key: per order column (descending, least, largest, has nulls)."""

    def __init__(self, columns: Sequence[tuple[bool, int, int, bool]]):
        self.columns = list(columns)
        self.widths = [(int(has_null), (high - low).bit_length()) for _, low, high, has_null in self.columns]
        self.bits = sum(a + b for a, b in self.widths)
        self.bytes = max(1, -(-self.bits // 8))

    def slices(self, values: list[np.ndarray], nulls: list[np.ndarray]) -> list[np.ndarray]:
        """One array of bits per slice, the highest first."""
        out = []
        for (down, low, high, has_null), (_, width), v, null in zip(self.columns, self.widths, values, nulls, strict=True):
            v = np.where(null, high if down else low, v)
            code = (np.uint64(high & C._MASK) - v.astype(np.uint64)) if down else (v.astype(np.uint64) - np.uint64(low & C._MASK))
            if has_null:
                out.append(null)
            out += [(code >> np.uint64(t)) & np.uint64(1) for t in reversed(range(width))]
        return [x.astype(bool) for x in out]


def keys_of(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> Keys:
    """The layout that the rows' values need: one row of bounds comes to the driver."""
    found = rows.agg(*[f(c).alias(f"{n}_{c}") for c, _ in order for n, f in (("low", F.min), ("high", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]).first()
    return Keys([(down, found[f"low_{c}"] or 0, found[f"high_{c}"] or 0, bool(found[f"nulls_{c}"])) for c, down in order])


# ---------------------------------------------------------------- index

def index(rows: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], keys: Keys, places: int) -> DataFrame:
    """Entries: group columns, ``entry`` (an id), ``n``, a bitmap per slice (s0, s1, ...), and the rows' columns as lists.

    Rows that are not among the first ``places`` keys of their entry are left out.
    """
    others = [c for c in rows.columns if c not in groups]
    fields = [StructField(c, LongType()) for c in (*groups, "entry", "n")] + [StructField(f"s{t}", BinaryType()) for t in range(keys.bits)] + [StructField(c, ArrayType(LongType())) for c in others]

    def build(batches):
        task, made = _task(), 0
        for block in _blocks(batches):
            flat = {c: block.column(c).combine_chunks() for c in block.column_names}
            values = {c: (np.asarray(a.fill_null(0)), np.asarray(a.is_null())) for c, a in flat.items()}
            new = np.zeros(block.num_rows, bool)
            new[:1] = True
            for c in groups:
                for x in values[c]:
                    new[1:] |= x[1:] != x[:-1]
            bits = keys.slices([values[c][0] for c, _ in order], [values[c][1] for c, _ in order])
            starts, sizes = _runs_of(np.flatnonzero(new), block.num_rows)
            maps = Bitmaps(sizes, [_packed(x, starts, sizes) for x in bits])
            maps.look(np.arange(len(sizes)), np.zeros((len(sizes), keys.bytes), np.uint8), 0)
            for t in range(keys.bits):
                maps.down(t, places)
            which, nth = maps.hits()
            left = np.sort(starts[maps.entry[which]] + nth)
            heads = np.searchsorted(left, starts)  # every entry has rows left
            sizes = np.diff(np.append(heads, len(left)))
            arrays = [flat[c].take(pa.array(starts)) for c in groups]
            arrays += [pa.array((task << 40) + made + np.arange(len(starts))), pa.array(sizes)]
            made += len(starts)
            arrays += [C.binaries(_packed(x[left], heads, sizes), -(-sizes // 8)) for x in bits]
            ends = pa.array(np.append(heads, len(left)).astype(np.int32))
            arrays += [pa.ListArray.from_arrays(ends, flat[c].take(pa.array(left))) for c in others]
            yield from pa.Table.from_arrays(arrays, names=[f.name for f in fields]).to_batches(max_chunksize=1 << 12)
        C.give_back()

    number = C.unused(rows.columns, "_number")
    dealt = rows.withColumn(number, F.monotonically_increasing_id()).repartitionByRange(*groups, number).sortWithinPartitions(*groups).drop(number)
    return C.written(dealt.mapInArrow(build, StructType(fields)), "slices")


def _runs_of(heads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs that begin at heads, cut to ``RUN`` rows."""
    cuts = -(-np.diff(np.append(heads, n)) // RUN)
    starts = np.repeat(heads, cuts) + RUN * C.ranges(np.zeros(len(cuts), np.int64), cuts)
    return starts, np.diff(np.append(starts, n))


def _packed(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of runs, each from a byte of its own on."""
    wide = -(-sizes // 8)
    padded = np.zeros(8 * int(wide.sum()), bool)
    padded[np.repeat(8 * (np.cumsum(wide) - wide) - starts, sizes) + np.arange(len(bits))] = bits
    return np.packbits(padded)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _blocks(batches):
    """Batches put together to ``BLOCK`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- descent

class Bitmaps:
    """Entries, with a bitmap for each (entry, prefix) that is looked at."""

    def __init__(self, n: np.ndarray, slices: list[np.ndarray]):
        self.n, self.slices = n, slices
        self.wide = -(-n // 8)
        self.starts = np.cumsum(self.wide) - self.wide

    @classmethod
    def of(cls, batch: pa.RecordBatch, slices: int) -> Bitmaps:
        return cls(np.asarray(batch.column("n")), [np.frombuffer(b"".join(batch.column(f"s{t}").to_pylist()), np.uint8) for t in range(slices)])

    def look(self, entries: np.ndarray, prefixes: np.ndarray, known: int) -> None:
        """Begin with the rows whose first ``known`` bits are the prefixes' (as rows of bytes)."""
        self.entry, self.prefix = entries, prefixes
        wide, n = self.wide[entries], self.n[entries]
        self.at = C.ranges(self.starts[entries], wide)
        self.rows = np.full(len(self.at), 0xFF, np.uint8)
        self.rows[np.cumsum(wide) - 1] = (0xFF00 >> ((n - 1) % 8 + 1)) & 0xFF
        for t in range(known):
            unset = np.where(self.bit(t), 0, 0xFF).astype(np.uint8)
            self.rows &= self.slices[t][self.at] ^ np.repeat(unset, wide)
        self.keep(self.counts() > 0)

    def bit(self, t: int) -> np.ndarray:
        return (self.prefix[:, t >> 3] >> (7 - (t & 7))) & 1

    def counts(self) -> np.ndarray:
        """Set bits per (entry, prefix)."""
        wide = self.wide[self.entry]
        return np.add.reduceat(np.bitwise_count(self.rows).astype(np.int64), np.cumsum(wide) - wide) if len(wide) else np.empty(0, np.int64)

    def keep(self, which: np.ndarray) -> None:
        cells = np.repeat(which, self.wide[self.entry])
        self.entry, self.prefix, self.at, self.rows = self.entry[which], self.prefix[which], self.at[cells], self.rows[cells]

    def down(self, t: int, places: int) -> None:
        """Split every bitmap by slice t; of each entry the first ``places`` prefixes with rows stay."""
        wide = self.wide[self.entry]
        both = np.repeat(np.arange(len(self.entry)), 2)
        one = np.arange(len(both)) % 2
        cells = C.ranges((np.cumsum(wide) - wide)[both], wide[both])
        flip = np.repeat(np.where(one, 0, 0xFF).astype(np.uint8), wide[both])
        self.rows = self.rows[cells] & (self.slices[t][self.at[cells]] ^ flip)
        self.at, self.entry, self.prefix = self.at[cells], self.entry[both], self.prefix[both]
        self.prefix[:, t >> 3] |= (one << (7 - (t & 7))).astype(np.uint8)
        self.keep(self.counts() > 0)
        nth = np.arange(len(self.entry)) - np.searchsorted(self.entry, self.entry)
        self.keep(nth < places)

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the bitmap, row of its entry) of all set bits."""
        wide = self.wide[self.entry]
        found = np.flatnonzero(np.unpackbits(self.rows))
        starts = 8 * (np.cumsum(wide) - wide)
        which = np.searchsorted(starts, found, "right") - 1
        return which, found - starts[which]


def _runs(batches, width: int):
    """Parts of batches whose bitmaps, with ``width`` of them an entry, come to ``ANDED`` bytes or a single entry's."""
    for batch in batches:
        ends = np.cumsum(-(-np.asarray(batch.column("n")) // 8) * width)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ANDED, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    C.give_back()


def _frontier(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, prefix as a row of bytes) from the column of frontiers."""
    lists = part.column("frontier")
    flat = lists.flatten()
    sizes = np.asarray(pa.compute.list_value_length(lists))
    return np.repeat(np.arange(part.num_rows), sizes), np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(-1, size).copy()


def _reached(entries: DataFrame, frontier: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Entries with the frontier of their group; what meets by group are ids without bitmaps."""
    ids, known = entries.select(*groups, "entry"), frontier.select(*[F.col(c).alias(f"_{c}") for c in groups], "frontier", "sums")
    same = F.lit(True)
    for c in groups:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    told = ids.join(known, same).select(F.col("entry").alias("_entry"), "frontier", "sums")
    return entries.select(*columns).join(told, F.col("entry") == F.col("_entry")).drop("_entry")


def descend(entries: DataFrame, groups: Sequence[str], keys: Keys, places: int, step: int = 4) -> DataFrame:
    """Per group its first ``places`` keys (``frontier``, bytes in their order) and the rows at each (``sums``)."""
    frontier, bits, size = None, keys.bits, keys.bytes
    fields = [*[StructField(c, LongType()) for c in groups], StructField("prefix", BinaryType()), StructField("count", LongType())]
    for known in range(0, max(bits, 1), step):
        ends = min(known + step, bits)

        def count(batches, known=known, ends=ends):
            for part in _runs(batches, 2 * places):
                maps = Bitmaps.of(part, ends)
                maps.look(*(_frontier(part, size) if known else (np.arange(part.num_rows), np.zeros((part.num_rows, size), np.uint8))), known)
                for t in range(known, ends):
                    maps.down(t, places)
                own = pa.array(maps.entry)
                prefixes = C.binaries(maps.prefix.reshape(-1), np.full(len(maps.prefix), size))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(own) for c in groups], prefixes, pa.array(maps.counts())], names=[f.name for f in fields])

        columns = [*groups, "entry", "n", *[f"s{t}" for t in range(ends)]]
        asked = entries.select(*columns) if frontier is None else _reached(entries, frontier, groups, columns).drop("sums")
        sums = asked.mapInArrow(count, StructType(fields)).groupBy(*groups, "prefix").agg(F.sum("count").alias("count"))
        # At most places * 2^step prefixes a group.
        firsts = sums.groupBy(*groups).agg(F.slice(F.sort_array(F.collect_list(F.struct("prefix", "count"))), 1, places).alias("first"))
        before, frontier = frontier, C.written(firsts.select(*groups, F.col("first.prefix").alias("frontier"), F.col("first.count").alias("sums")), "frontier")
        if before is not None:
            C.forget(before)
    return frontier


def fetch(entries: DataFrame, frontier: DataFrame, groups: Sequence[str], columns: Sequence[str], keys: Keys) -> DataFrame:
    """Rows whose key is on their group's frontier: group and other columns, place, tied, ahead (rows at earlier places), entry, nth."""
    names = [*groups, *columns, "place", "tied", "ahead", "entry", "nth"]

    def run(batches):
        for part in _runs(batches, 8 * len(columns) + 1):
            maps = Bitmaps.of(part, keys.bits)
            sizes = np.asarray(pa.compute.list_value_length(part.column("frontier")))
            owner, prefixes = _frontier(part, keys.bytes)
            place = C.ranges(np.zeros(len(sizes), np.int64), sizes)
            tied = np.asarray(part.column("sums").flatten())
            total = np.cumsum(tied) - tied
            ahead = total - np.repeat(total[np.cumsum(sizes) - sizes], sizes)
            # Bitmaps without rows are dropped by ``look``: their number is kept in two more bytes of the prefix.
            tag = place.astype("<u2").view(np.uint8).reshape(-1, 2)
            maps.look(owner, np.hstack([prefixes, tag]), keys.bits)
            which, nth = maps.hits()
            entry = maps.entry[which]
            at = (np.cumsum(sizes) - sizes)[entry] + maps.prefix[which, keys.bytes:].copy().view("<u2").reshape(-1)
            arrays = [part.column(c).take(pa.array(entry)) for c in groups]
            starts = np.cumsum(maps.n) - maps.n
            arrays += [part.column(c).flatten().take(pa.array(starts[entry] + nth)) for c in columns]
            arrays += [pa.array(place[at] + 1), pa.array(tied[at]), pa.array(ahead[at]), part.column("entry").take(pa.array(entry)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    asked = _reached(entries, frontier, groups, [*groups, "entry", "n", *[f"s{t}" for t in range(keys.bits)], *columns])
    return asked.mapInArrow(run, StructType([StructField(c, LongType()) for c in names]))


def first_places(rows: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], ties: Sequence[str], places: int = 5, step: int = 4) -> DataFrame:
    """Rows with one of the first ``places`` different keys of their group: the columns named, place, pos and tied.

    ``order``: (column, descending). ``ties`` order rows of one key, nulls last. All columns are longs.
    """
    columns = list(dict.fromkeys([*(c for c, _ in order), *ties]))
    named = rows.select(*groups, *columns)
    keys = keys_of(named, order)
    entries = index(named, groups, order, keys, places)
    frontier = descend(entries, groups, keys, places, step)
    found = fetch(entries, frontier, groups, columns, keys)
    # An entry's id and a row's place in it tell equal rows apart, so ranges of this order are even.
    at = numbered(found, [*[F.asc_nulls_last(c) for c in ties], F.col("entry"), F.col("nth")], [*groups, "place"], "_nth")
    return at.select(*groups, *columns, "place", (F.col("ahead") + F.col("_nth")).alias("pos"), "tied")
