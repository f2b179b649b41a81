"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a bit is one if it is set in over half of the XXH64 values of a text's word shingles.
Links: fingerprints that differ in at most ``bits`` bits. The 64 bits are grouped into partitions,
correlated bits together, and a partition gets its own threshold: by the pigeonhole principle, if the
thresholds plus one add up to ``bits`` + 1, some partition of every linked pair differs within its
threshold. A dynamic program allocates the thresholds, from the candidate counts measured on all
fingerprints. Equal fingerprints are one class from the start, so that groups of copies cost one row.

Skew: a bucket with more than ``BUCKET`` classes is dealt anew by its other bits (pigeonhole again, as
deep as needed), so no bucket is unbounded and none is capped. Buckets yield a spanning star of their
links, not all pairs. Where links are verified (``keep_one``), buckets yield spanning forests of the pairs
that may hold, then, of nodes that these have not brought together, all pairs that may.

Buckets are dealt over tasks whose number follows the rows, and streamed: a task holds some buckets, or one
bucket's classes and some of those that probe it.

Defined results: null or empty texts have no words and fingerprint zero, linked like any other; null
ids take part, and a component of null ids only has a null id; repeated rows share a class; empty tables
give no rows; other columns, whatever their names, pass through ``keep_one`` and are not read otherwise.
"""

from __future__ import annotations

import functools
import itertools
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components, local_roots

SEED = 42
#: Different fingerprints that one bucket compares pair by pair; larger ones are dealt anew.
BUCKET = 16384
#: What a row that probes costs, in comparisons.
ROW_COST = 1000.0
#: Probing rows of one task, and of those that are compared at once (or counted at once, where partitions are planned).
TASK_ROWS, HELD_ROWS = 1 << 18, 1 << 17


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), np.uint64, len(words) - size + 1)


def fingerprint(text: bytes, size: int) -> int:
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[part:part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every document."""
    def run(batches):
        for part in C.slices(batches, "text"):
            fps = np.array([fingerprint(t, size) for t in C.raw_texts(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds

def bit_moments(classes: DataFrame) -> np.ndarray:
    """64 x 64 counts of classes that have both bits, over all classes."""
    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(0, len(fps), 65536):
                ones = np.unpackbits(fps[part:part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += ones.T @ ones
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j].astype(np.int64))], ["cell", "n"])

    out = np.zeros(64 * 64)
    for r in classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(64, 64)


def group_bits(moments: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of about equal size; each takes in turn the bit most correlated with those it has."""
    p = np.diag(moments) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((moments / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda b: (corr[b, list(left)].sum(), -b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks that flip at most ``radius`` of the bits."""
    return [mask_of(list(c)) for r in range(radius + 1) for c in itertools.combinations(bits, r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(costs: list[list[float]], budget: int) -> list[int]:
    """Thresholds (-1: unused) with sum(threshold + 1) == budget and the least sum of costs[part][threshold]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, budget - used):
                total = cost + (row[t] if t >= 0 else 0.0)
                key = used + t + 1
                if key not in step or total < step[key][0]:
                    step[key] = total, [*chosen, t]
        best = step
    return best[budget][1]


def pairs_by_mask(classes: DataFrame, masks: list[int], band) -> dict[int, float]:
    """Per mask the ordered pairs of classes (within a band, each with itself too) that agree in all bits of the mask.

    A task sums up the values of its own classes before it hands anything on: at most a row per value of a mask and band,
    however many classes have it.
    """
    def run(batches):
        fps: list[np.ndarray] = []
        bands: list[np.ndarray] = []
        rows = 0

        def counted():
            fp, own = np.concatenate(fps), np.concatenate(bands)
            for m in masks:
                v = fp & np.int64(m)
                order = np.lexsort((v, own))
                v, b = v[order], own[order]
                first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (b[1:] != b[:-1])))
                n = np.diff(np.append(first, len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), m, np.int64)), pa.array(v[first]), pa.array(b[first]), pa.array(n)], ["m", "v", "band", "n"])

        for batch in batches:
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
            bands.append(batch.column("band").to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                yield from counted()
                fps, bands, rows = [], [], 0
        if rows:
            yield from counted()

    sums = classes.select("fp", band.cast("long").alias("band")).mapInArrow(run, "m long, v long, band long, n long").groupBy("m", "v", "band").agg(F.sum("n").alias("n"))
    return {r.m: r.pairs for r in sums.groupBy("m").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).collect()}


def plan(classes: DataFrame, bits: int, band=None) -> list[tuple[int, int, list[int]]]:
    """(partition mask, threshold, bits) of the partitions in use, by the least estimated cost.

    A partition costs the pairs (within a band) that its threshold lets through and the rows that probe it.
    """
    n = classes.count()
    moments = bit_moments(classes)
    least = max(2, (bits + 1) // 2)
    options = [group_bits(moments, n, parts) for parts in sorted({least, (least + bits + 1) // 2, bits + 1})]
    masks = sorted({signed(mask_of(g)) for groups in options for g in groups})
    pairs = pairs_by_mask(classes, masks, F.lit(0) if band is None else band)
    chosen = None
    for groups in options:
        costs = []
        for g in groups:
            near = [sum(comb(len(g), r) for r in range(t + 1)) for t in range(bits + 1)]
            costs.append([pairs.get(signed(mask_of(g)), 0.0) * k + ROW_COST * n * k for k in near])
        thresholds = allocate(costs, bits + 1)
        total = sum(c[t] for c, t in zip(costs, thresholds, strict=True) if t >= 0)
        if chosen is None or total < chosen[0]:
            chosen = total, [(mask_of(g), t, g) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    return chosen[1]


# ---------------------------------------------------------------- probe and verify

def _in_step(batch: pa.Table, bits: int):
    """The sorted node names of one shard, the name and label of each row, and an iterator over the links within its buckets.

    Rows at home stand for their own value, others probe a neighbouring one; all are compared with
    those at home, one after the other, all buckets in step: (rows, their partners, differing bits).
    """
    key, fp, home, node = (batch.column(c).to_numpy() for c in ("bucket", "fp", "home", "node"))
    label = batch.column("label").to_numpy() if "label" in batch.column_names else None
    # Rows of a bucket's most frequent label are of one group already: they meet the other labels' only.
    common = _most_common(key, label) if label is not None else np.zeros(len(key), bool)
    order = np.lexsort((fp, common, ~home.astype(bool), key))
    key, fp, home, node, common = key[order], fp[order].view(np.uint64), home[order].astype(bool), node[order], common[order]
    label = node if label is None else label[order]
    second = batch.column("second").to_numpy()[order].view(np.uint64) if "second" in batch.column_names else None
    outlines = Outlines(batch, order) if "outline" in batch.column_names else None
    names, node = np.unique(node, return_inverse=True)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    homes = np.add.reduceat(home, first, dtype=np.int64) if len(first) else first
    begin, many = np.repeat(first, sizes), np.repeat(homes, sizes)
    if len(first):
        others = np.add.reduceat(home & ~common, first, dtype=np.int64)
        many = np.where(common, np.repeat(others, sizes), many)

    def steps():
        live, d = np.flatnonzero(many > 0), 0
        while len(live):
            other = begin[live] + d
            apart = np.bitwise_count(fp[live] ^ fp[other])
            near = np.flatnonzero((apart <= bits) & (node[live] != node[other]))
            if second is not None and len(near):
                near = near[apart[near].astype(np.int64) + np.bitwise_count(second[live[near]] ^ second[other[near]]) <= JOINT]
            if len(near):
                yield live[near], other[near], apart[near]
            d += 1
            live = live[many[live] > d]

    return names, node, label, outlines, steps()


def _most_common(key: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows that have the most frequent label of their bucket."""
    order = np.lexsort((label, key))
    k, x = key[order], label[order]
    heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]))) if len(k) else np.empty(0, np.int64)
    counts = np.diff(np.append(heads, len(k)))
    best = heads[np.lexsort((-counts, k[heads]))]
    best = best[np.append(True, k[best][1:] != k[best][:-1])] if len(best) else best
    out = np.zeros(len(k), bool)
    which = np.isin(heads, best)
    out[order] = np.repeat(which, counts)
    return out


class Outlines:
    """Of rows' shingle sets: sizes, and how many shingles fall into each of 256 bins (4 bits each; none for large sets)."""

    def __init__(self, batch: pa.Table, order: np.ndarray):
        column = batch.column("outline").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        there = pc.binary_length(column).to_numpy() == BINS // 2
        self.place = np.where(there, np.cumsum(there) - 1, -1)[order]
        self.bins = np.frombuffer(b"".join(x for x in column.to_pylist() if len(x) == BINS // 2), np.uint8).reshape(-1, BINS // 2)
        self.size = batch.column("size").to_numpy()[order]

    def most(self, row: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The largest Jaccard similarity that the pairs can have: sets share no more in a bin than the lesser has there."""
        least = np.minimum(self.size[row], self.size[other])
        shared = least.copy()
        known = np.flatnonzero((self.place[row] >= 0) & (self.place[other] >= 0))
        for part in range(0, len(known), 1 << 15):
            k = known[part:part + (1 << 15)]
            a, b = self.bins[self.place[row[k]]], self.bins[self.place[other[k]]]
            shared[k] = np.minimum(a & 15, b & 15).sum(axis=1, dtype=np.int64) + np.minimum(a >> 4, b >> 4).sum(axis=1, dtype=np.int64)
        shared = np.minimum(shared, least)
        whole = self.size[row] + self.size[other] - shared
        return np.where(whole > 0, shared / np.maximum(whole, 1), 1.0)


#: Bits in which two fingerprints of 64 bits may differ together: 19 on average, with a deviation of 4, at a similarity of 0.8.
JOINT = 34
#: Bins of an outline, and the largest set that has one (so that no bin overflows).
BINS, OUTLINED = 256, 1000


def outline(shingles: np.ndarray) -> bytes:
    """The bins of a set of hashes; empty if it is too large for them."""
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (BINS - 1), minlength=BINS)
    if len(shingles) > OUTLINED or counts.max() > 15:
        return b""
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def _compare(batch: pa.Table, bits: int) -> pa.Table:
    """Spanning stars of the links within the buckets of one shard (not all of them links themselves)."""
    names, node, _, _, steps = _in_step(batch, bits)
    roots = np.arange(len(names))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for row, other, _ in steps:
        held.append((node[row], node[other]))
        size += len(row)
        if size > 2_000_000:
            roots, held, size = local_roots(len(names), *map(np.concatenate, zip(*held, strict=True)), roots), [], 0
    if held:
        roots = local_roots(len(names), *map(np.concatenate, zip(*held, strict=True)), roots)
    own = np.flatnonzero(roots != np.arange(len(names)))
    return pa.table({"u": names[own], "v": names[roots[own]]})


def _nearest(batch: pa.Table, bits: int) -> pa.Table:
    """Of the links within the buckets of one shard, those of each row with its first and its nearest partner.

    Every node that has links is an end of one of these.
    """
    names, node, _, _, steps = _in_step(batch, bits)
    first, best, least = np.full(len(node), -1), np.full(len(node), -1), np.full(len(node), 65)
    for row, other, apart in steps:
        fresh, closer = first[row] < 0, apart < least[row]
        first[row[fresh]] = other[fresh]
        best[row[closer]], least[row[closer]] = other[closer], apart[closer]
    own = np.flatnonzero(first >= 0)
    return _distinct_pairs(names, [_pair_keys(node[own], node[to[own]], len(names)) for to in (first, best)])


def _crossing(batch: pa.Table, bits: int, similarity: float = 0.0) -> pa.Table:
    """All links within the buckets of one shard between nodes whose labels differ, and that may have the similarity."""
    names, node, label, outlines, steps = _in_step(batch, bits)
    held: list[np.ndarray] = []
    size = 0
    for row, other, _ in steps:
        apart = label[row] != label[other]
        row, other = row[apart], other[apart]
        if outlines is not None and len(row):
            may = outlines.most(row, other) >= similarity
            row, other = row[may], other[may]
        held.append(_pair_keys(node[row], node[other], len(names)))
        size += len(held[-1])
        if size > 2_000_000:
            held, size = [np.unique(np.concatenate(held))], 0
    return _distinct_pairs(names, held)


def _forest(batch: pa.Table, bits: int, similarity: float = 0.0) -> pa.Table:
    """Of the links that ``_crossing`` gives, a spanning forest over the labels, likeliest links first."""
    names, node, label, outlines, steps = _in_step(batch, bits)
    labels = np.unique(label, return_inverse=True)[1]
    none = np.empty(0, np.int64)
    kept = (none, none, np.empty(0))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def grown():
        return _spanning(len(labels), labels, *map(np.concatenate, zip(kept, *held, strict=True)))

    for row, other, near in steps:
        apart = label[row] != label[other]
        row, other = row[apart], other[apart]
        weight = outlines.most(row, other) if outlines is not None else 1.0 - near[apart] / 64
        may = weight >= similarity
        held.append((row[may], other[may], weight[may]))
        size += int(may.sum())
        if size > 1_000_000:
            kept, held, size = grown(), [], 0
    kept = grown()
    return _distinct_pairs(names, [_pair_keys(node[kept[0]], node[kept[1]], len(names))])


def _spanning(n: int, labels: np.ndarray, row: np.ndarray, other: np.ndarray, weight: np.ndarray):
    """The edges of a heaviest spanning forest: every tree takes its best edge, until none is left."""
    roots, chosen = np.arange(n), []
    live = np.arange(len(row))
    while True:
        x, y = roots[labels[row[live]]], roots[labels[other[live]]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            take = np.concatenate(chosen) if chosen else live
            return row[take], other[take], weight[take]
        ends, edge = np.concatenate((x, y)), np.tile(np.arange(len(live)), 2)
        order = np.lexsort((edge, -weight[live[edge]], ends))
        best = np.unique(edge[order[np.flatnonzero(np.diff(ends[order], prepend=-1))]])
        chosen.append(live[best])
        roots = local_roots(n, x[best], y[best], roots)


def _pair_keys(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(a, b) * n + np.maximum(a, b)


def _distinct_pairs(names: np.ndarray, keys: list[np.ndarray]) -> pa.Table:
    found = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    n = max(len(names), 1)
    return pa.table({"u": names[found // n], "v": names[found % n]})


def _streamed(batches, bits: int, compare):
    """``compare`` over rows that come by bucket, those at home first: some buckets at once, or a part of one."""
    def table_of(parts):
        return pa.Table.from_batches(parts).combine_chunks()

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for start in range(0, batch.num_rows, HELD_ROWS):
            held.append(batch.slice(start, HELD_ROWS))
            rows += len(held[-1])
            if rows < HELD_ROWS:
                continue
            whole = table_of(held)
            key = whole.column("bucket").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from compare(whole.slice(0, cut), bits).to_batches()
                rest = whole.slice(cut)
            else:  # a bucket goes on: its own classes stay, to meet those that probe it yet
                yield from compare(whole, bits).to_batches()
                rest = whole.filter(whole.column("home"))
            held = rest.combine_chunks().to_batches()
            rows = 0 if not cut else len(rest)
    if held:
        yield from compare(table_of(held), bits).to_batches()
    C.give_back()


def links(classes: DataFrame, bits: int = 3, bucket: int = BUCKET, banded: bool = False, compare=_compare) -> DataFrame:
    """(u, v): links between nodes that join the same nodes as all pairs within ``bits`` bits do.

    ``classes``: fp and node. Of a fingerprint that occurs many times all rows stay in one bucket, as no bits can part
    them: a bucket is dealt anew only for its different fingerprints, and its rows of one label are not compared
    with each other. If banded, only pairs whose ``band``
    differs by at most one are looked for (a column that bounds the similarity from above, such as a
    size class). ``compare`` may instead give ``_nearest`` links or, of nodes with a ``label``, all
    ``_crossing`` ones or a ``_forest`` of them; these can occur more than once. With a ``second``
    fingerprint, links differ in ``JOINT`` bits of both at most.
    """
    extra = [c for c in classes.columns if c in ("second", "label", "outline", "size")]
    band = F.col("band") if banded else F.lit(0)
    # Each class probes, per partition, the values that its own can have been changed into, in its band and the next.
    probes = [
        (k, signed(mask), signed(flip), ahead, signed(((1 << 64) - 1) ^ mask)) for k, (mask, t, group) in enumerate(plan(classes, bits, band)) for flip in ball(group, t) for ahead in ((0, 1) if banded else (0,))]
    named = classes.select("fp", "node", *extra, band.cast("long").alias("own"))

    def dealt(chosen):
        """A row per class and chosen probe. The number of the probe is exploded: the masks stay out of the plan's text."""
        every = F.expr(f"array({', '.join(f'named_struct("k", {k}, "mask", {m}L, "flip", {f}L, "ahead", {a}L, "rest", {r}L)' for k, m, f, a, r in chosen)})")
        value = F.col("fp").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip"))
        return named.select("*", F.explode(F.array(*map(F.lit, range(len(chosen))))).alias("probe")).withColumn("x", every[F.col("probe")]).select(
            F.xxhash64("x.k", value, F.col("own") + F.col("x.ahead")).alias("bucket"), "fp", "node", ((F.col("x.flip") == 0) & (F.col("x.ahead") == 0)).alias("home"), F.col("x.rest").alias("rest"), *extra)

    # Buckets are counted by the classes at home in them, so only those are made for it.
    whole, at_home = dealt(probes), dealt([p for p in probes if p[2] == 0 and p[3] == 0])
    count = classes.count() * len(probes)
    found, used = None, []
    while True:
        # A bucket with no more free bits than ``bits`` holds few classes and stays.
        full = C.written(at_home.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.bit_count("rest")).alias("free")).where((F.col("n") > bucket) & (F.col("free") > bits)).select("bucket"), "full-buckets")
        # Of the buckets with many rows, those with many different fingerprints.
        prints = at_home.join(full, "bucket", "left_semi").select("bucket", "fp").distinct()
        hot = C.written(prints.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("bucket"), "hot-buckets") if full.take(1) else full
        used += [full] * (hot is not full)
        used.append(hot)
        any_hot = bool(hot.take(1))
        cold = (whole.join(hot, "bucket", "left_anti") if any_hot else whole).drop("rest")
        tasks = C.tasks(count, TASK_ROWS)
        stars = cold.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.desc("home")).mapInArrow(lambda batches: _streamed(batches, bits, compare), "u long, v long")
        found = stars if found is None else found.unionByName(stars)
        if not any_hot:
            out = C.written(found, "links")
            C.forget(*used)
            return out
        # Within a hot bucket, the other bits of a linked pair differ in at most ``bits`` places: split them again.
        again = whole.join(hot, "bucket", "left_semi").mapInArrow(lambda batches: _dealt_anew(batches, bits), whole.schema)
        whole = C.written(again.distinct(), "buckets")
        at_home = whole.where("home")
        used.append(whole)
        count = whole.count()


def _dealt_anew(batches, bits: int):
    for batch in batches:
        bucket, fp, node, home, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp", "node", "home", "rest"))
        for mask in np.unique(rest).tolist():
            own = np.flatnonzero(rest == mask)
            free = [b for b in range(64) if mask >> b & 1]
            pieces = [free[k::bits + 1] for k in range(bits + 1)]
            for k, piece in enumerate(pieces):
                m = np.int64(signed(mask_of(piece)))
                mixed = C.mix(C.mix(bucket[own].view(np.uint64) + np.uint64(k + 1)) ^ C.mix((fp[own] & m).view(np.uint64) + np.uint64(77)))
                left = np.full(len(own), signed((mask & ((1 << 64) - 1)) & ~mask_of(piece)), np.int64)
                extra = [batch.column(c).take(pa.array(own)) for c in batch.schema.names[5:]]
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(fp[own]), pa.array(node[own]), pa.array(home[own]), pa.array(left), *extra], schema=batch.schema)


def near_groups(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) for every document."""
    prints = C.written(fingerprints(docs, size), "fingerprints")
    classes = C.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    pairs = links(classes.select("fp", F.col("fp").alias("node")), bits)
    joined = components(pairs)
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = C.written(rooted.join(least, "root").select("fp", "component_id"), "components")
    C.forget(classes, pairs)
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- keep one of each group

#: The fingerprints that look for candidates: each alone misses some of the pairs at the similarity.
PRINTS = ("fp", "fp2")


def _sizes_and_prints(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Fingerprints, and bands of the number of different shingles: sets in bands further apart than one are less similar."""
    step = np.log(max(1.25, 1 / similarity))

    def run(batches):
        for part in C.slices(batches, "text"):
            prints: list[list[int]] = [[] for _ in PRINTS]
            sizes, outlines = [], []
            for text in C.raw_texts(part.column("text")):
                hashes = shingle_hashes(text, size)
                for k, own in enumerate(prints):
                    own.append(majority(C.mix(hashes + np.uint64(k)) if k else hashes))
                different = np.unique(hashes)
                sizes.append(len(different))
                outlines.append(outline(different))
            band = np.floor(np.log(np.maximum(sizes, 1)) / step).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in prints), pa.array(band), pa.array(sizes, pa.int64()), pa.array(outlines, pa.binary())], ["doc_id", "node", *PRINTS, "band", "size", "outline"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, f"doc_id long, node long, {', '.join(f'{p} long' for p in PRINTS)}, band long, size long, outline binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) if len(a) or len(b) else 1.0


def similar_pairs(read: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of (u, v) pairs of nodes, those whose texts (``read``: node, text) have similar shingle sets."""
    def verify(batches):
        last, known = None, None
        for batch in batches:
            for part in C.slices([batch], "a"):
                keep = []
                for v, a, b in zip(*(part.column(c).to_pylist() for c in ("v", "a", "b")), strict=True):
                    if v != last:
                        last, known = v, np.unique(shingle_hashes(C.grown(b), size))
                    keep.append(jaccard(np.unique(shingle_hashes(C.grown(a), size)), known) >= similarity)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = C.written(pairs.distinct(), "candidates")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    texts = C.written(C.shrunk(read.select("node", "text")).join(ends, "node", "left_semi").dropDuplicates(["node"]), "candidate-texts")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    found = C.written(both.select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"), "verified")
    C.forget(pairs, texts)
    return found


class _Candidates:
    """The candidate pairs of one fingerprint, ruled out by the other where that is far off. Nodes with equal ones in a band are one class, named by its least node."""

    def __init__(self, nodes: DataFrame, fp: str, bits: int, similarity: float):
        self.bits, self.similarity = bits, similarity
        other = next(p for p in PRINTS if p != fp)
        self.nodes = nodes.select("node", F.col(fp).alias("fp"), F.col(other).alias("second"), "band", "size", "outline")
        classes = C.written(self.nodes.groupBy("fp", "second", "band").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
        pairs = links(classes.select("fp", F.col("head").alias("node"), "band", "second"), bits, banded=True, compare=_nearest)
        self.near = C.written(pairs.distinct(), "near")
        # Nodes that have any candidate: their class has, or is not theirs alone.
        linked = self.near.select(F.col("u").alias("head")).union(self.near.select(F.col("v").alias("head"))).union(classes.where("n > 1").select("head")).distinct()
        members = self.nodes.join(classes.select("fp", "second", "band", "head"), ["fp", "second", "band"])
        self.linked = C.written(members.join(linked, "head", "left_semi"), "linked")
        C.forget(pairs, classes)
        self.used = [self.near, self.linked]

    def first(self) -> DataFrame:
        """Pairs that touch every node that has candidates: with its class's head, its first and its nearest candidate."""
        return self.near.unionByName(self.linked.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))

    def apart(self, roots: DataFrame, compare) -> DataFrame:
        """Candidate pairs of nodes with different ``roots`` (node, root) that may be similar: all, or a forest of them."""
        similarity = self.similarity
        labelled = C.written(self.linked.join(roots, "node", "left").select("fp", "second", "node", "band", F.coalesce("root", "node").alias("label"), "size", "outline"), "labelled")
        pairs = links(labelled, self.bits, banded=True, compare=lambda batch, bits: compare(batch, bits, similarity))
        self.used += [labelled, pairs]
        return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def keep_one(docs: DataFrame, size: int = 5, bits: int = 12, similarity: float = 0.8) -> DataFrame:
    """The documents of which no near copy has a smaller id, with all their columns.

    Texts within ``bits`` bits by one of two independent fingerprints, and ``JOINT`` by both, are candidates, if
    their size classes differ by at most one; groups are the components of the candidate pairs whose shingle sets have the
    Jaccard ``similarity``. Each text is first verified with its first and nearest candidates, then groups
    with each other along the likeliest pairs, then all candidate pairs that are not in one group by now and
    whose sets can be similar by their outlines (which bound the similarity from above). Rows with the same
    id and text are one document, of which all rows stay or go; a null id is larger than any other; null and
    empty texts are copies of each other; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("node", C.row_key())
    prints = C.written(_sizes_and_prints(read, size, similarity), "prints")
    # Equal texts are one node.
    nodes = C.written(prints.groupBy("node", *PRINTS, "band", "size", "outline").agg(F.min("doc_id").alias("first_id")), "nodes")
    searches = [_Candidates(nodes, fp, bits, similarity) for fp in PRINTS]
    ordered = [s.first().select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")) for s in searches]
    verified = [similar_pairs(read, ordered[0].unionByName(ordered[1]), size, similarity)]
    used = []
    for compare in (_forest, _crossing):
        roots = C.written(components(functools.reduce(DataFrame.unionByName, verified)), "roots")
        left = [s.apart(roots, compare) for s in searches]
        verified.append(similar_pairs(read, left[0].unionByName(left[1]), size, similarity))
        used.append(roots)
    held = components(functools.reduce(DataFrame.unionByName, verified))
    rooted = nodes.join(held, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n"))
    of_node = rooted.join(least, "root").select("node", "least_id")
    later = prints.join(of_node, "node").where((F.col("doc_id") > F.col("least_id")) | (F.col("doc_id").isNull() & F.col("least_id").isNotNull()))
    near_id, near_node = C.unused(docs.columns, "near_id"), C.unused(docs.columns, "near_node")
    gone = C.written(later.select(F.col("doc_id").alias(near_id), F.col("node").alias(near_node)).distinct(), "near-copies")
    C.forget(prints, nodes, *verified, *used, *(t for s in searches for t in s.used))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(near_id)) & (F.xxhash64(text) == F.col(near_node)), "left_anti")
