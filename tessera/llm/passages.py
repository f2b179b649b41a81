"""Repeated passages: the distributed frame around the two substring indexes.

A window is ``size`` units (words or bytes). Every window is anchored at the least-hashed run of
``gram`` units within it, which depends on its content only, so equal windows of any documents share
an anchor hash. Consecutive windows with one anchor make a passage. The steps:

1. (map) anchors of all documents: rows (anchor hash, passage hash, id, place), no text;
2. anchors that occur once are dropped: their windows cannot repeat;
3. equal passages become one row with their first place (a partial aggregate, so a passage in a third of
   all documents is one row per task), and only that place is cut from its text;
4. passages go to shards by anchor hash; each shard builds its index (``aligned``), streams every passage
   against it and gets, for each of its windows, the earliest place that holds it;
5. the answers go back to all places of the passages: a window of any place is repeated if the earliest
   place that the index gave for it comes before. What no index has answered is not removed.

Skew: an anchor whose different passages have more than ``ANCHOR_UNITS`` units is anchored anew: their
windows are dealt by a longer run within them, at last by the whole window. Nothing is capped or
dropped. Memory: a slice of text (or one text if longer), or one index of about ``INDEX_BYTES`` of
passages and at most one anchor more.

Rows whose doc_id is null have no place in the order: they lose nothing and remove nothing. Passages are
told apart by 128 bits of hashes, units of different passages are compared in the index.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import common as C
from .aligned import Passages, earliest

#: Passages of one task of the search, in bytes (a word is taken for six).
SHARD_BYTES = 16 << 20
#: Passages that one index holds, in bytes; whole anchors go on until it is reached.
INDEX_BYTES = 2 << 20
ANCHOR_UNITS = 1 << 20
#: Units whose windows are anchored at once.
CHUNK = 1 << 21
_PLACE = np.uint64((1 << 24) - 1)
#: A unit's place, and a row's key among rows of one id, in the order of places.
_PLACE_BITS, _KEY_BITS = 31, 32


@dataclass(frozen=True)
class Units:
    """What a text is made of."""

    words: bool
    size: int
    gram: int
    #: Whether an earlier place in the same document counts.
    within: bool

    def __post_init__(self):
        if not 0 < self.gram <= self.size < 1 << 20:
            raise ValueError("a window has 1 to 2^20 units, and its anchor at most as many")

    @property
    def base(self) -> int:
        return C.WORD_BASE if self.words else C.BYTE_BASE

    def finer(self) -> Units:
        """Anchors of more units, half way to whole windows."""
        more = (self.gram + self.size + 1) // 2
        return dataclasses.replace(self, gram=self.size if self.size - more < 8 else more)

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A number for every unit of all texts, and the units where each text begins (and the last ends)."""
        if not self.words:
            joined = np.frombuffer(b"".join(texts), np.uint8)
            return joined.astype(np.uint64) + np.uint64(1), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if len(texts) > 1 or (texts and len(texts[0]) <= 2 * CHUNK):
            found = C.Words(texts, C.SPACES)
            return found.hashes(), found.first
        parts = [C.Words([p], C.SPACES).hashes() for t in texts for p in _pieces(t)]
        return (np.concatenate(parts), np.array([0, sum(map(len, parts))])) if parts else (np.empty(0, np.uint64), np.zeros(1, np.int64))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    start = 0
    while start < len(text):
        stop = start + CHUNK
        while stop < len(text) and C.SPACES[text[stop]]:
            stop += 1
        yield text[start:stop]
        start = stop


@dataclass
class Found:
    """Passages of a slice: text (its number), h (anchor), sid (content), start, at (of the anchor), n (windows)."""

    text: np.ndarray
    h: np.ndarray
    sid: np.ndarray
    start: np.ndarray
    at: np.ndarray
    n: np.ndarray


def anchors(texts: list[bytes], units: Units) -> Found:
    """The passages of all windows."""
    values, first = units.values(texts)
    counts = np.maximum(np.diff(first) - units.size + 1, 0)
    out = [_anchored(values, first, counts, a, min(a + CHUNK, len(values)), units) for a in range(0, max(len(values), 1), CHUNK)]
    return out[0] if len(out) == 1 else Found(*(np.concatenate([getattr(o, f.name) for o in out]) for f in dataclasses.fields(Found)))


def _anchored(values: np.ndarray, first: np.ndarray, counts: np.ndarray, begin: int, end: int, units: Units) -> Found:
    """Passages of the windows that start at units ``begin`` to ``end``."""
    texts = np.arange(len(counts))
    low = np.clip(begin, first[:-1], first[:-1] + counts)
    many = np.clip(end, first[:-1], first[:-1] + counts) - low
    starts = C.ranges(low, many)
    if not len(starts):
        return Found(*(np.empty(0, np.int64),) * 6)
    values = values[begin:end + units.size - 1]
    total = C.running(values, units.base)
    width = units.size - units.gram + 1
    at = np.arange(len(values) - units.gram + 1)
    hashes = C.span_of(total, at, at + units.gram, units.base)
    least = (hashes & ~_PLACE) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[:span - width], least[width - span:])
    place = (least[starts - begin] & _PLACE).astype(np.int64)
    owner = np.repeat(texts, many)
    run = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    n = np.diff(np.append(run, len(place)))
    start = starts[run] - begin
    sid = C.span_of(total, start, start + n - 1 + units.size, units.base)
    text = owner[run]
    return Found(text, hashes[place[run]].view(np.int64), sid.view(np.int64), start + begin - first[text], place[run] - start, n)


def _shape(at, n):
    return at << 32 | n


# ---------------------------------------------------------------- places and passages

PLACES = "h long, sid long, doc_id long, text_key int, start int, shape long"


def _places(docs: DataFrame, units: Units) -> DataFrame:
    def run(batches):
        for part in C.slices(batches, "text"):
            f = anchors(C.raw_texts(part.column("text")), units)
            own = pa.array(f.text)
            yield pa.RecordBatch.from_arrays([
                pa.array(f.h), pa.array(f.sid), part.column("doc_id").take(own), part.column("text_key").take(own), pa.array(f.start.astype(np.int32)), pa.array(_shape(f.at, f.n))], [
                "h", "sid", "doc_id", "text_key", "start", "shape"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, PLACES)


def _distinct(places: DataFrame, units: Units) -> DataFrame:
    """Passages with their first place; aggregates of fixed width, so that Spark hashes and need not sort."""
    unit = F.lit(Decimal(1 << _PLACE_BITS + _KEY_BITS))
    rest = F.shiftleft(F.col("start").cast("long"), _KEY_BITS) + (F.col("text_key").cast("long") + (1 << _KEY_BITS - 1))
    order = F.col("doc_id").cast("decimal(19,0)") * unit + rest
    many = F.count("*") > 1 if units.within else F.min("doc_id") < F.max("doc_id")
    if "many" in places.columns:
        many = many | F.max("many")
    found = places.groupBy("h", "sid").agg(F.min("doc_id").alias("doc_id"), F.min(order).alias("order"), F.max("shape").alias("shape"), many.alias("many"))
    rest = (F.col("order") - F.col("doc_id").cast("decimal(19,0)") * unit).cast("long")
    key = (rest.bitwiseAND((1 << _KEY_BITS) - 1) - (1 << _KEY_BITS - 1)).cast("int")
    return found.select("h", "sid", "doc_id", key.alias("text_key"), F.shiftright(rest, _KEY_BITS).cast("int").alias("start"), "shape", "many")


def _units_of(units: Units):
    return F.col("shape").bitwiseAND(0xFFFFFFFF) + (units.size - 1)


def _hot(found: DataFrame, units: Units, limit: int) -> DataFrame:
    """Anchors whose different passages are too many for one index."""
    sums = found.groupBy("h").agg(F.sum(_units_of(units)).alias("units"), F.count("*").alias("k"))
    return C.written(sums.where((F.col("units") > limit) & (F.col("k") > 1)).select("h"), "hot-anchors")


PASSAGES = "h long, sid long, doc_id long, start int, shape long, many boolean, s binary"
_PASSAGE_NAMES = ["h", "sid", "doc_id", "start", "shape", "many", "s"]


def _cut(found: DataFrame, texts: DataFrame, units: Units) -> DataFrame:
    """The passages with their strings (of words: with the white space between them)."""
    hits = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "sid", "start", "shape", "many")).alias("hits"))

    def run(batches):
        for batch in batches:
            for part, raw in C.packed_slices([batch]):
                own, sizes = part.column("hits"), pc.list_value_length(part.column("hits")).to_numpy()
                hits = own.flatten()
                text = np.repeat(np.arange(len(raw)), sizes)
                start = hits.field("start").to_numpy().astype(np.int64)
                length = (hits.field("shape").to_numpy() & 0xFFFFFFFF) + units.size - 1
                s = _strings(raw, units, text, start, length)
                rest = [hits.field(c) for c in ("h", "sid")], [hits.field(c) for c in ("start", "shape", "many")]
                yield pa.RecordBatch.from_arrays([*rest[0], part.column("doc_id").take(pa.array(text)), *rest[1], s], _PASSAGE_NAMES)

    return texts.join(hits, ["doc_id", "text_key"]).mapInArrow(run, PASSAGES)


def _strings(raw: list[bytes], units: Units, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The stretches of the given units as bytes."""
    if units.words:
        words = C.Words(raw, C.SPACES)
        data, first = words.bytes, words.first[text] + start
        begin, end = words.starts[first], words.ends[first + length - 1]
    else:
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(t) for t in raw])))[text] + start
        end = begin + length
    return C.binaries(data[C.ranges(begin, end - begin)], end - begin)


CHILDREN = "parent long, parent_sid long, ahead int, h long, sid long, doc_id long, text_key int, start int, shape long, many boolean, s binary"


def _anew(passages: DataFrame, units: Units) -> DataFrame:
    """The passages of hot anchors, anchored anew: each with the parts (``ahead`` units on) that it falls into."""
    def run(batches):
        for part in C.slices(batches, "s"):
            raw = C.raw_texts(part.column("s"))
            f = anchors(raw, units)
            own = pa.array(f.text)
            # Within an anchor only: windows that match share both.
            h = C.mix(f.h.view(np.uint64) + C.mix(part.column("h").to_numpy().view(np.uint64))[f.text]).view(np.int64)
            place = part.column("start").to_numpy()[f.text] + f.start
            s = _strings(raw, units, f.text, f.start, f.n + units.size - 1)
            yield pa.RecordBatch.from_arrays([
                part.column("h").take(own), part.column("sid").take(own), pa.array(f.start.astype(np.int32)), pa.array(h), pa.array(f.sid), part.column("doc_id").take(own),
                pa.array(np.zeros(len(h), np.int32)), pa.array(place.astype(np.int32)), pa.array(_shape(f.at, f.n)), part.column("many").take(own), s], [x.split()[0] for x in CHILDREN.split(", ")])

    return passages.mapInArrow(run, CHILDREN)


# ---------------------------------------------------------------- search

ANSWERS = "h long, sid long, last_id long, last_start long, runs array<struct<start:int,stop:int>>"


def _answers(passages: DataFrame, units: Units, transform: Callable, total: int) -> DataFrame:
    """What the index of each shard says of its passages: see ``answer``."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("s").nbytes
            if size < INDEX_BYTES:
                continue
            # The last anchor may go on in the next batch.
            whole = pa.Table.from_batches(held).combine_chunks()
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            for done in _indexes(whole.slice(0, cut)):
                yield answer(done, units, transform)
            held = whole.slice(cut).to_batches()
            size = sum(b.column("s").nbytes for b in held) if cut else size
        if held:
            for done in _indexes(pa.Table.from_batches(held).combine_chunks()):
                yield answer(done, units, transform)
        C.give_back()

    shards = C.tasks(total * (6 if units.words else 1), SHARD_BYTES)
    return passages.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(run, ANSWERS)


def _indexes(whole: pa.Table) -> Iterator[pa.Table]:
    """Rows in parts of about ``INDEX_BYTES``; an anchor's passages stay together."""
    if not whole.num_rows:
        return
    h = whole.column("h").to_numpy()
    ends = np.cumsum(pc.binary_length(whole.column("s")).to_numpy())
    start = 0
    while start < len(h):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + INDEX_BYTES, "right"))
        stop = max(stop, start + 1)
        stop = int(np.searchsorted(h, h[stop - 1], "right"))
        yield whole.slice(start, stop - start)
        start = stop


def answer(part: pa.Table, units: Units, transform: Callable) -> pa.RecordBatch:
    """Of each passage that has repeated windows: the last of the earliest places of its windows, as a place of
    the passage (places after it lose all windows), and the windows that come before its own first place."""
    h, doc, start, shape = (part.column(c).to_numpy() for c in ("h", "doc_id", "start", "shape"))
    at, n = shape >> 32, shape & 0xFFFFFFFF
    strings = part.column("s").combine_chunks()
    strings = strings.chunk(0) if isinstance(strings, pa.ChunkedArray) else strings
    group = np.cumsum(np.diff(h, prepend=h[0]) != 0)
    anchor = start + at
    # The order of places as ranks; places that are not told apart share one.
    keys = (anchor, doc) if units.within else (doc,)
    order = np.lexsort(keys)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(np.any([np.diff(k[order], prepend=k[order[0]]) != 0 for k in keys], axis=0))
    holder = np.empty(rank.max() + 1, np.int64)
    holder[rank] = np.arange(len(h))
    first = earliest(Passages(strings, units.words, group, at, n), rank, units.size, transform)
    there = np.arange(first.shape[0])[:, None] < n[None, :]
    known = there & (first >= 0)
    last = np.where(known, first, -1).max(axis=0)
    whole = (last >= 0) & (known == there).all(axis=0)
    before = known & (first < rank[None, :])
    keep = np.flatnonzero(whole & (part.column("many").to_numpy(zero_copy_only=False) | before.any(axis=0)))
    edges = np.diff(before[:, keep].view(np.int8), axis=0, prepend=np.int8(0), append=np.int8(0)).T
    owner, opens = np.nonzero(edges > 0)
    _, closes = np.nonzero(edges < 0)
    sizes = np.bincount(owner, minlength=len(keep))
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(opens.astype(np.int32)), pa.array(closes.astype(np.int32))], ["start", "stop"]))
    held = holder[last[keep]]
    return pa.RecordBatch.from_arrays([
        pa.array(h[keep]), part.column("sid").take(pa.array(keep)).combine_chunks(), pa.array(doc[held]), pa.array(anchor[held] - at[keep]), runs], ["h", "sid", "last_id", "last_start", "runs"])


def spans(docs: DataFrame, units: Units, transform: Callable, anchor_units: int | None = None) -> DataFrame:
    """doc_id, text_key, spans: the unit ranges that repeat an earlier place (they may overlap).

    ``transform`` is the index of one column of a shard; see ``aligned``.
    """
    limit = ANCHOR_UNITS if anchor_units is None else anchor_units
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    places = C.written(_places(docs, units), "anchors")
    twice = F.count("*") > 1 if units.within else F.min("doc_id") < F.max("doc_id")
    # Written, so that both sides of the join are plain shuffles and Spark can split a hot anchor's side.
    again = C.written(places.groupBy("h").agg(twice.alias("again")).where("again").select("h"), "repeated-anchors")
    own = C.written(places.join(again.hint("shuffle_hash"), "h", "left_semi"), "repeated-places")
    C.forget(again, places)
    found = C.written(_distinct(own, units), "distinct-passages")
    used, passages, level = [own, found], None, units
    total = found.agg(F.sum(_units_of(units))).first()[0] or 0
    hot = _hot(found, units, limit)
    used.append(hot)
    if not hot.take(1):
        passages = _cut(found, C.shrunk(docs), units)
    else:
        strings = C.written(_cut(found, C.shrunk(docs), units), "passages")
        used.append(strings)
        while level.gram < level.size and hot.take(1):
            level = level.finer()
            parts = C.written(_anew(strings.join(hot, "h", "left_semi"), level), "anchored-anew")
            cold = strings.join(hot, "h", "left_anti")
            passages = cold if passages is None else passages.unionByName(cold)
            moved = own.join(hot, "h", "left_semi").withColumnRenamed("h", "parent").withColumnRenamed("sid", "parent_sid").withColumnRenamed("start", "from").drop("shape") \
                .join(parts.select("parent", "parent_sid", "ahead", "h", "sid", "shape").distinct(), ["parent", "parent_sid"]).select("h", "sid", "doc_id", "text_key", (F.col("from") + F.col("ahead")).cast("int").alias("start"), "shape")
            own = C.written(own.join(hot, "h", "left_anti").unionByName(moved), "repeated-places")
            found = _distinct(parts.select("h", "sid", "doc_id", "text_key", "start", "shape", "many"), level).drop("text_key")
            texts = parts.groupBy("h", "sid").agg(F.first("s").alias("s"))
            strings = C.written(found.join(texts, ["h", "sid"]).select(*_PASSAGE_NAMES), "passages")
            hot = _hot(strings, units, limit)
            used += [parts, own, strings, hot]
            total += strings.agg(F.sum(_units_of(units))).first()[0] or 0
        passages = passages.unionByName(strings)
    answers = C.written(_answers(passages, units, transform, total), "answers")
    later = (F.col("doc_id") > F.col("last_id")) | ((F.col("doc_id") == F.col("last_id")) & (F.col("start") > F.col("last_start"))) if units.within else F.col("doc_id") > F.col("last_id")
    n = F.col("shape").bitwiseAND(0xFFFFFFFF).cast("int")
    runs = F.when(later, F.array(F.struct(F.lit(0).alias("start"), n.alias("stop")))).otherwise(F.col("runs"))
    moved = F.transform(runs, lambda r: F.struct((r.start + F.col("start")).alias("start"), (r.stop + F.col("start") + (units.size - 1)).alias("stop")))
    cut = own.join(answers.hint("shuffle_hash"), ["h", "sid"]).select("doc_id", "text_key", F.explode(moved).alias("span"))
    out = C.written(cut.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans")), "spans")
    C.forget(answers, *used)
    return out


# ---------------------------------------------------------------- removal

def remove(docs: DataFrame, found: DataFrame, units: Units, kept: str = "kept") -> DataFrame:
    """All columns of ``docs`` with the text that is left (``kept``), n_units, n_removed, n_spans.

    Words that are left are joined by one space; bytes that are left are joined as they are (binary).
    Columns of ``docs`` with those names (in any case) are not kept.
    """
    names = C.others(docs.columns, kept, "n_units", "n_removed", "n_spans")
    rest = C.others(names, "text")
    text = F.col("text").cast("string")
    rows = C.shrunk(docs.select(F.struct(*rest).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("text_key"), text.alias("text")))
    rows = rows.join(found, ["doc_id", "text_key"], "left").select("own", "text", "spans")

    def run(batches):
        for part, raw in C.packed_slices(batches):
            left, many, gone, runs = removed(raw, part.column("spans"), units)
            whole = pa.array([t if there else None for there, t in zip(part.column("text").is_valid().to_pylist(), raw, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("own"), whole, left.cast(pa.string()) if units.words else left, pa.array(many), pa.array(gone), pa.array(runs)], ["own", "text", "left", "many", "gone", "runs"])

    kinds = (("text", StringType()), ("left", StringType() if units.words else BinaryType()), ("many", LongType()), ("gone", LongType()), ("runs", LongType()))
    out = rows.mapInArrow(run, StructType([rows.schema["own"], *(StructField(*k) for k in kinds)]))
    columns = [F.col("text").alias(c) if c.lower() == "text" else F.col("own").getField(c).alias(c) for c in names]
    return out.select(*columns, F.col("left").alias(kept), F.col("many").alias("n_units"), F.col("gone").alias("n_removed"), F.col("runs").alias("n_spans"))


def removed(raw: list[bytes], found: pa.ListArray, units: Units) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: what is left, its units, how many are removed, and in how many runs."""
    if units.words:
        words = C.Words(raw, C.SPACES)
        first = words.first
    else:
        first = np.concatenate(([0], np.cumsum([len(t) for t in raw], dtype=np.int64)))
    n = int(first[-1])
    owner = np.repeat(first[:-1], pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    cuts = found.flatten()
    gone = C.marked(cuts.field("start").to_numpy() + owner, cuts.field("stop").to_numpy() + owner, n)
    opens = gone & ~np.concatenate(([False], gone[:-1])) if n else gone
    inner = first[:-1][first[:-1] < n]
    opens[inner] = gone[inner]  # a run does not go on into the next text
    total, runs = (np.concatenate(([0], np.cumsum(x))) for x in (gone, opens))
    counts = np.diff(first)
    lost, many = total[first[1:]] - total[first[:-1]], runs[first[1:]] - runs[first[:-1]]
    if not units.words:
        return C.binaries(np.frombuffer(b"".join(raw), np.uint8)[~gone], counts - lost), counts, lost, many
    keep = np.flatnonzero(~gone)
    size = words.ends[keep] - words.starts[keep] + 1
    data = words.bytes[C.ranges(words.starts[keep], size)]
    ends = np.cumsum(size)
    data[ends - 1] = 0x20  # what follows a word is white space
    text = np.searchsorted(first, keep, "right") - 1
    last = np.flatnonzero(np.diff(text, append=-1)) if len(keep) else np.empty(0, np.int64)
    sizes = np.bincount(text, weights=size, minlength=len(raw)).astype(np.int64)
    sizes[text[last]] -= 1
    solid = np.ones(len(data), bool)
    solid[ends[last] - 1] = False  # no space after the last word
    return C.binaries(data[solid], sizes), counts, lost, many
