"""Benchmark decontamination by suffix arrays of the training documents.

Every Arrow slice of documents is a shard with its own (sparse) suffix array: the suffixes that begin
with a few words that also begin some test suffix, sorted by their words to the depth of a window.
Each test window is then searched by binary search, one word of depth at a time and all windows at
once, which gives all its places in the shard. The suffixes of the array are searched in turn, by binary
search among the sorted test suffixes, for the longest stretch of words that they share with any (from
``LEAD`` words on), and where. The text never moves; only the test side is broadcast, in blocks of
``BLOCK_BYTES`` whose size is checked first, each with one pass over the documents.

Defined results: null or empty texts have no words and are clean; items that are null, empty or have
a null id take no part; items with equal ids count once; repeated documents are judged each by itself;
columns of the documents other than ``doc_id`` and ``text`` are not read by ``find`` and pass through
``clean``, whatever their names; an empty table of either kind gives no rows, or no hits; of equally long
matches the first in the document is given, and any one of the places in the items.
Memory: one slice, or one text if longer, plus one block of test items (about ten times its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Words by which a suffix is chosen for the sparse array.
LEAD = 3

MATCHES = "doc_id long, text_key long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>, longest int, longest_at int, longest_item string, longest_item_at int"


class Tests:
    """A block of items: their windows, distinct rows of word hashes each with the items that hold it, and their sorted suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = C.Words([t.encode() for _, t in items], C.PLAIN, lower=True)
        self.hashes, self.first = words.hashes(), words.first
        self.names = [i for i, _ in items]
        found: dict[bytes, tuple[int, set[str]]] = {}
        for d, (item, _) in enumerate(items):
            row = self.hashes[self.first[d]:self.first[d + 1]]
            size = min(window, len(row))
            for i in range(len(row) - size + 1 if size else 0):
                found.setdefault(row[i:i + size].tobytes(), (size, set()))[1].add(item)
        keys = list(found)
        self.sizes = np.array([found[k][0] for k in keys], np.int64)
        self.items = [sorted(found[k][1]) for k in keys]
        self.words = np.zeros((len(keys), window), np.uint64)
        for r, k in enumerate(keys):
            self.words[r, :self.sizes[r]] = np.frombuffer(k, np.uint64)
        self.lead = int(min(LEAD, self.sizes.min(initial=LEAD)))
        # Suffixes of all items, each up to its item's end.
        self.ends = np.repeat(self.first[1:], np.diff(self.first))
        self.suffixes = suffix_order(self.hashes, self.ends)
        self.total = C.running(self.hashes, C.WORD_BASE)
        begins = np.flatnonzero(np.arange(len(self.hashes)) + self.lead <= self.ends)
        rows = self.hashes[begins[:, None] + np.arange(self.lead)]
        self.leads = np.unique(lead_hashes(rows, self.lead)) if len(rows) else np.empty(0, np.uint64)


def suffix_order(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their words' hashes, by doubling; one that ends goes before those that go on."""
    n, span = len(hashes), 1
    if not n:
        return np.empty(0, np.int64)
    place = np.arange(n)
    rank = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        ahead = np.minimum(place + span, n - 1)
        key = rank * (n + 2) + np.where(place + span < ends, rank[ahead], 0)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        span *= 2
        if span >= (ends - place).max():
            return order


def lead_hashes(columns: np.ndarray, lead: int) -> np.ndarray:
    out = np.zeros(len(columns), np.uint64)
    for t in range(lead):
        out = out * np.uint64(C.WORD_BASE) + columns[:, t]
    return out


class SuffixArray:
    """Suffixes of the words of one shard that begin as some test suffix does, sorted to the depth of a window.

    Words are ranked by their hash; a place past the end of its document ranks below all words.
    """

    def __init__(self, hashes: np.ndarray, text_ends: np.ndarray, tests: Tests):
        n, depth = len(hashes), tests.words.shape[1]
        lead, place = np.zeros(n, np.uint64), np.arange(n)
        for t in range(tests.lead):
            lead = lead * np.uint64(C.WORD_BASE) + np.append(hashes[t:], np.zeros(min(t, n), np.uint64))
        at = np.searchsorted(tests.leads, lead)
        fits = tests.leads[np.minimum(at, len(tests.leads) - 1)] == lead
        self.places = place[fits & (place + tests.lead <= text_ends)]
        left = text_ends[self.places] - self.places
        steps = np.arange(depth)
        columns = hashes[np.minimum(self.places[:, None] + steps, n - 1)] if n else np.zeros((0, depth), np.uint64)
        columns = np.where(steps < left[:, None], columns, np.uint64(0))
        order = np.lexsort(columns.T[::-1])
        self.places, self.columns = self.places[order], np.ascontiguousarray(columns[order].T)
        self.hashes, self.text_ends = hashes, text_ends

    def longest(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the array, the length of its longest match with a test suffix, and that suffix's place."""
        total, places = C.running(self.hashes, C.WORD_BASE), self.places
        left = self.text_ends[places] - places
        best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(tests.suffixes))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            own, other = places[open_], tests.suffixes[mid]
            most = np.minimum(left[open_], tests.ends[other] - other)
            # Words in common, by bisection on hashes of stretches.
            a, b = np.zeros(len(own), np.int64), most.copy()
            while (a < b).any():
                half = (a + b + 1) >> 1
                same = C.span_of(total, own, own + half, C.WORD_BASE) == C.span_of(tests.total, other, other + half, C.WORD_BASE)
                a, b = np.where(same, half, a), np.where(same, b, half - 1)
            longer = a > best[open_]
            best[open_[longer]], where[open_[longer]] = a[longer], other[longer]
            # The test suffix is the smaller one if it ends here or goes on with a smaller word.
            goes_on = a < most
            mine = self.hashes[np.minimum(own + a, len(self.hashes) - 1)]
            theirs = tests.hashes[np.minimum(other + a, len(tests.hashes) - 1)]
            smaller = np.where(goes_on, theirs < mine, other + a == tests.ends[other])
            lo[open_[smaller]], hi[open_[~smaller]] = mid[smaller] + 1, mid[~smaller]
        return best, where

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """For each test window the interval of suffixes that begin with it; empty if none does."""
        k = len(tests.sizes)
        lo, hi = np.zeros(k, np.int64), np.full(k, len(self.places))
        live = np.arange(k)
        for t in range(len(self.columns)):
            live = live[(tests.sizes[live] > t) & (lo[live] < hi[live])]
            if not len(live):
                break
            column, wanted, a, b = self.columns[t], tests.words[live, t], lo[live], hi[live]
            lo[live] = bisect(column, wanted, a, b, right=False)
            hi[live] = bisect(column, wanted, lo[live], b, right=True)
        return lo, hi


def bisect(column: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every wanted value within its own range of the column."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        value, want = column[mid], wanted[open_]
        up = value <= want if right else value < want
        lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
    return lo


class Scan(NamedTuple):
    """Of one text: its words, merged word spans that are hit, items found, its longest match: words, place, item, place there."""

    n_words: int
    spans: list[tuple[int, int]]
    items: list[str]
    longest: int
    at: int | None
    item: str | None
    item_at: int | None


def scan(texts: list[bytes], tests: Tests, matches: bool = True) -> Iterator[Scan]:
    """The findings of every text; without ``matches``, longest ones are not looked for."""
    words = C.Words(texts, C.PLAIN, lower=True)
    n, counts = len(words.starts), words.counts()
    hits: dict[int, tuple[list[tuple[int, int]], list[str]]] = {}
    longest: dict[int, tuple[int, int, str, int]] = {}
    if n and len(tests.sizes):
        array = SuffixArray(words.hashes(), np.repeat(words.first[1:], counts), tests)
        best, where = array.longest(tests) if matches else (np.empty(0, np.int64),) * 2
        of = np.searchsorted(words.first, array.places[:len(best)], "right") - 1
        order = np.lexsort((array.places[:len(best)], -best, of))
        for k in order[np.diff(of[order], prepend=-1) != 0].tolist():
            d, item = int(of[k]), int(np.searchsorted(tests.first, where[k], "right") - 1)
            longest[d] = int(best[k]), int(array.places[k] - words.first[d]), tests.names[item], int(where[k] - tests.first[item])
        lo, hi = array.search(tests)
        owner = np.repeat(np.arange(len(lo)), hi - lo)
        places = array.places[C.ranges(lo, hi - lo)]
        doc = np.searchsorted(words.first, places, "right") - 1
        covered = C.marked(places, places + tests.sizes[owner], n)
        edges = np.flatnonzero(np.diff(covered.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        pairs = np.unique(np.stack([doc, owner]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
        for d, first, last in zip(*[x.tolist() for x in _runs(pairs[0])], strict=True):
            names = sorted({i for r in pairs[1][first:last].tolist() for i in tests.items[r]})
            a, b = words.first[d], words.first[d + 1]
            cuts = np.concatenate(([a], edges[np.searchsorted(edges, a, "right"):np.searchsorted(edges, b)], [b]))
            spans = [(int(s - a), int(e - a)) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if covered[s]]
            hits[d] = spans, names
    for d, count in enumerate(counts.tolist()):
        yield Scan(count, *hits.get(d, ([], [])), *longest.get(d, (0, None, None, None)))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array with the bounds of their runs."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], first, np.append(first[1:], len(keys)) if len(first) else first


def tainted(n_words: int, spans: list[tuple[int, int]], share: int = 20) -> bool:
    """Contaminated: some word is hit, and at least one word in ``share``."""
    n_hit = sum(e - s for s, e in spans)
    return n_hit > 0 and share * n_hit >= n_words


def blocks(items: DataFrame, window: int) -> Iterator[Tests]:
    """Test sides of checked size, each ready to be broadcast; one at a time."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL AND text <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()
        yield Tests(sorted((r.item_id, r.text) for r in rows), window)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_MATCHES = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string()),
    ("longest_item_at", pa.int32())])


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, the spans that are hit, the items found there, and its longest match with its places."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.row_key().alias("text_key"), F.col("text").cast("string").alias("text"))

    def over(tests):
        held = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches):
            for part in C.slices(batches, "text"):
                rows = list(scan(C.raw_texts(part.column("text")), held.value))
                spans = [[{"start": s, "stop": e} for s, e in r.spans] for r in rows]
                own = [[r[k] for r in rows] if k != 1 else spans for k in range(7)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *(pa.array(v, f.type) for v, f in zip(own, list(_MATCHES)[2:], strict=True))], schema=_MATCHES)

        return docs.mapInArrow(run, MATCHES)

    parts = [over(t) for t in blocks(items, window)]
    if len(parts) == 1:
        return parts[0]
    # Several blocks of items: bring the findings of a document together (as many rows as blocks).
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    best = F.struct("longest", (-F.col("longest_at")).alias("before"), "longest_item", "longest_item_at")
    whole = whole.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max(best).alias("best"), F.floor(F.count("*") / len(parts)).alias("copies"))
    rows = whole.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "text_key", "n_words", "spans", "items", "best.longest", (-F.col("best.before")).alias("longest_at"), "best.longest_item", "best.longest_item_at").mapInArrow(_merged, MATCHES)


def _merged(batches):
    """Overlapping and touching spans as one."""
    for batch in batches:
        first = np.concatenate(([0], np.cumsum(batch.column("n_words").to_numpy() + 1)))  # texts do not touch
        found = batch.column("spans")
        own = np.repeat(first[:-1], pc.list_value_length(found).to_numpy())
        cuts = found.flatten()
        covered = C.marked(cuts.field("start").to_numpy() + own, cuts.field("stop").to_numpy() + own, int(first[-1]))
        edges = np.flatnonzero(np.diff(covered.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        opens, closes = edges[0::2], edges[1::2]
        row = np.searchsorted(first, opens, "right") - 1
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(batch))))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array((x - first[row]).astype(np.int32)) for x in (opens, closes)], ["start", "stop"])
        columns = [pa.ListArray.from_arrays(pa.array(ends), spans) if c == "spans" else batch.column(c) for c in _MATCHES.names]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _MATCHES, strict=True)], schema=_MATCHES)


def with_verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated to the rows of ``find``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x.stop - x.start))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BLOCK_BYTES:  # several passes: their findings are brought together first
        taint_id, taint_key = C.unused(docs.columns, "taint_id"), C.unused(docs.columns, "taint_key")
        bad = with_verdict(find(docs, items, window), share).where("contaminated").select(F.col("doc_id").alias(taint_id), F.col("text_key").alias(taint_key)).distinct()
        return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(taint_id)) & (C.row_key() == F.col(taint_key)), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(next(blocks(items, window)))

    def run(batches):
        for part in C.slices(batches, "text"):
            rows = scan(C.raw_texts(part.column("text")), held.value, matches=False)
            yield part.filter(pa.array([not tainted(r.n_words, r.spans, share) for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
