"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Fixed ranks below 2^20 are supported. Pre-tokens are doubly linked lists of parts. Every adjacent pair that
some token spells waits in the bucket of that token's rank; a bitmap of three levels marks the buckets that
hold something, so the least rank is found by three find-first-set steps, however much waits. Entries are
never removed when a merge makes them invalid: they are stale and skipped when their bucket is read. The
unseen pre-tokens of a slice share one queue, each with a list of its own: merges of different pre-tokens
do not touch each other, one find-first-set serves all that wait at a rank, and a large bucket is merged at
once. Lists are held in 32-bit cells (16 bytes per byte), however long a pre-token is.

Encoding is a map over documents: no shuffle. The rank file (at most ``RANK_FILE_BYTES``, checked) is
broadcast. Encodings of short pre-tokens are kept per worker, in two tables of at most ``KEPT_BYTES``.

Defined results: null texts are empty; an empty text has no ids and decodes to no bytes; a vocabulary that
lacks a byte, and ids that are null, negative or unknown to it, fail; null ids lists stay null; empty tables
give no rows; columns named as the result (in any case) are replaced, others pass through.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import common as C

RANK_FILE_BYTES = 64 << 20
#: Of one generation of kept pre-tokens, and of kept ranks of pairs (entries).
KEPT_BYTES, KEPT_PAIRS = 96 << 20, 1 << 20
KEPT_LENGTH = 48
#: Bytes of text that are encoded at once, of their unseen pre-tokens that share a queue, and the positions of a
#: bucket from which on they are merged together.
SLICE, SHARED, TOGETHER = 1 << 21, 1 << 19, 64
#: The characters of the Unicode property White_Space.
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def load_ranks(spark, path: str) -> list[bytes | None]:
    """Tokens by rank from a file of lines "base64 rank", read through Spark; its size is checked."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size > RANK_FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {RANK_FILE_BYTES}")
    pairs = [r.value.split() for r in spark.read.text(path).collect() if r.value.strip()]
    out: list[bytes | None] = [None] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


#: Fixed value: the pattern whose pieces ``CONTRACTIONS`` stand first in.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PLANE = [*range(0xD800), *range(0xE000, 0x10000)]


def splitter(pattern: str):
    """``findall`` of the pattern with \\s and \\S meaning the Unicode property White_Space, as the rank files' library has it.

    Runs of letters and of numbers are tried before contractions: they begin with other characters, so
    the pieces are the same. Texts within the basic plane are split by a pattern that lists its characters
    of a property as ranges, which the standard library matches faster.
    """
    runs = r" ?\p{L}+| ?\p{N}+"
    pattern = pattern.replace(f"{CONTRACTIONS}|{runs}", f"{runs}|{CONTRACTIONS}").replace(r"\p{L}+|", r"\p{L}++|").replace(r"\p{N}+|", r"\p{N}++|")
    pattern = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    whole, plain = regex.compile(pattern).findall, _within_plane(pattern)
    if plain is None:
        return whole
    return lambda text: (plain if text.isascii() or len(text.encode("utf-16-le", "replace")) == 2 * len(text) else whole)(text)


def _within_plane(pattern: str):
    """The pattern for the standard library: properties become ranges; None where it has more than that library knows."""
    plane, known, inside, out = "".join(map(chr, _PLANE)), {}, False, []
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part.startswith(r"\p{"):
            if part not in known:
                spans = regex.findall(part + "+", plane)
                known[part] = "".join(re.escape(x[0]) + (f"-{re.escape(x[-1])}" if len(x) > 1 else "") for x in spans)
            part = known[part] if inside else f"[{known[part]}]"
        elif part[0] == "\\" and part[1:].isalpha() and part[1:] not in ("t", "r", "n", "x"):
            return None
        elif part == "[":
            if inside:
                return None
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    return re.compile("".join(out)).findall


class Vocabulary:
    """Tokens by rank, with their bytes one after the other."""

    def __init__(self, tokens: list[bytes | None]):
        if len(tokens) > 1 << 20:
            raise ValueError(f"ranks up to {len(tokens) - 1}; pairs of them are packed in 20 bits each")
        self.tokens = tokens
        self.rank = {t: r for r, t in enumerate(tokens) if t is not None}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"no token spells the bytes {missing}")
        self.known = np.array([t is not None for t in tokens])
        self.sizes = np.array([len(t or b"") for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of lists of ids that stand one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens) or not self.known[ids].all()):
            wrong = [i for i in ids.tolist() if not 0 <= i < len(self.tokens) or not self.known[i]]
            raise ValueError(f"no token has the id {wrong[0]}")
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        lists = np.concatenate(([0], np.cumsum(counts)))
        return C.binaries(self.data[C.ranges(self.starts[ids], sizes)], np.diff(ends[lists]))


class Encoder:
    """Ids of texts. ``low`` has a bit per rank, ``mid`` a bit per word of ``low``, and one number (``top``,
    within a merge) a bit per word of ``mid``. The queue is empty between merges, so one serves all. Its few
    operations are written out where they are used: calls would cost more than they do.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.split = splitter(pattern)
        self.tokens, self.rank = vocabulary.tokens, vocabulary.rank
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = np.array([self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32).reshape(256, 256)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.low = [0] * ((len(self.tokens) >> 6) + 1)
        self.mid = [0] * ((len(self.tokens) >> 12) + 1)
        self.pairs: dict[int, int] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their number per text."""
        found = [self.split(t) if t else [] for t in texts]
        kept, older = self.kept.get, self.older.get
        held: dict[str, bytes] = {}  # of these texts, small enough to be read fast
        fresh: dict[str, bytes] = {}
        unseen = []
        for piece in set().union(*found):
            ids = kept(piece)
            if ids is None:
                ids = older(piece)
                if ids is None:
                    unseen.append(piece)
                    continue
                fresh[piece] = ids
            held[piece] = ids
        start = 0
        coded = [p.encode("utf-8", "replace") for p in unseen]
        while start < len(coded):
            stop, size = start, 0
            while stop < len(coded) and (stop == start or size + len(coded[stop]) <= SHARED):
                size += len(coded[stop])
                stop += 1
            fresh.update(zip(unseen[start:stop], self.merged(coded[start:stop]), strict=True))
            start = stop
        held.update(fresh)
        parts = [b"".join(map(held.__getitem__, pieces)) for pieces in found]
        for piece, ids in fresh.items():
            if len(piece) <= KEPT_LENGTH:
                self.kept[piece] = ids
                self.kept_bytes += 200 + len(piece) + len(ids)
        if self.kept_bytes > KEPT_BYTES:
            self.older, self.kept, self.kept_bytes = self.kept, {}, 0
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) >> 2 for p in parts], np.int64)

    def pair(self, left: int, right: int) -> int:
        """Rank of the token that two tokens spell, or -1."""
        found = self.rank.get(self.tokens[left] + self.tokens[right], -1)
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = found
        return found

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``pair`` of many pairs; parts below 0 have none."""
        keys, at = np.unique(left.astype(np.int64) << 20 | right, return_inverse=True)
        known, out = self.pairs.get, np.empty(len(keys), np.int32)
        for k, key in enumerate(keys.tolist()):
            r = -1 if key < 0 else known(key)
            out[k] = self.pair(key >> 20, key & 0xFFFFF) if r is None else r
        return out[at]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes of 32-bit numbers."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        ranks = np.append(self.byte_pairs[data[:-1], data[1:]], np.int32(-1))
        ranks[ends - 1] = -1
        whole = [self.rank.get(p, -1) for p in pieces]
        for k in [k for k, r in enumerate(whole) if r >= 0]:  # a token itself: nothing to merge
            ranks[ends[k] - len(pieces[k]):ends[k]] = -1
        follow, precede = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[ends - 1], precede[ends[:-1]] = n, -1
        # Each list as cells that are read one by one, and as an array over the same memory.
        lists = Lists(self.single[data], follow, precede, ranks)
        queue: dict[int, list] = {}
        order = np.argsort(ranks, kind="stable")
        order = order[int(np.searchsorted(ranks[order], 0)):]
        top = self.push(queue, ranks[order], order, 0)
        low, mid = self.low, self.mid
        while top:
            # Find first set, level by level; take that bucket.
            k = (top & -top).bit_length() - 1
            word = mid[k]
            j = k << 6 | (word & -word).bit_length() - 1
            word = low[j]
            rank = j << 6 | (word & -word).bit_length() - 1
            low[j] = word = word & (word - 1)
            if not word:
                mid[k] = word = mid[k] & (mid[k] - 1)
                if not word:
                    top &= top - 1
            bucket = queue.pop(rank)
            single = [x for x in bucket if type(x) is int]
            many = [x for x in bucket if type(x) is not int]
            if len(single) + sum(map(len, many)) >= TOGETHER:
                positions = np.concatenate([*many, np.array(single, np.int64)])
                positions = np.unique(positions[lists.waiting[positions] == rank])  # others are stale
                found = self.together(lists, rank, positions)
                if found is not None:
                    top = self.push(queue, *found, top)
                    continue
                single, many = positions.tolist(), []
            for x in many:
                single += x.tolist()
            top = self.one_by_one(lists, rank, sorted(single), queue, top)
        cells = lists.part[:n]
        for k in [k for k, r in enumerate(whole) if r >= 0]:
            a = ends[k] - len(pieces[k])
            cells[a:ends[k]], cells[a] = -1, whole[k]
        alive = cells >= 0
        cuts = (np.concatenate(([0], np.cumsum(alive)[ends - 1])) * 4).tolist()
        raw = cells[alive].tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def mark(self, rank: int, top: int) -> int:
        """Set the bits of a rank whose bucket has become filled."""
        j, k = rank >> 6, rank >> 12
        self.low[j] |= 1 << (rank & 63)
        self.mid[k] |= 1 << (j & 63)
        return top | 1 << k

    def push(self, queue: dict, ranks: np.ndarray, positions: np.ndarray, top: int) -> int:
        """Put positions into the buckets of their ranks (ascending)."""
        opens = np.flatnonzero(np.diff(ranks, prepend=-1))
        starts = opens.tolist()
        for r, a, b in zip(ranks[opens].tolist(), starts, [*starts[1:], len(ranks)], strict=False):
            bucket = queue.get(r)
            if bucket is None:
                queue[r] = [positions[a:b]]
                top = self.mark(r, top)
            else:
                bucket.append(positions[a:b])
        return top

    def together(self, lists: Lists, rank: int, positions: np.ndarray):
        """Merge at all positions of a bucket at once; the (rank, position) pairs that wait then, by rank.

        None, with nothing done, if a pair of a lower rank comes up: then the order of merges matters.
        """
        part, after, before, waiting, n = lists.part, lists.after, lists.before, lists.waiting, lists.n
        # Of overlapping pairs (a run of equal parts) every other one merges, from the left.
        index = np.arange(len(positions))
        goes_on = np.concatenate(([False], after[positions[:-1]] == positions[1:]))
        i = positions[(index - np.maximum.accumulate(np.where(goes_on, 0, index))) & 1 == 0]
        j = after[i]
        end = after[j]
        inner = end < n
        old_part, old_next, old_waiting = part[i], part[j], waiting[j]
        passing = part[np.minimum(end, n)]
        part[i], part[j] = rank, -1
        after[i] = end
        before[end[inner]] = i[inner]
        h = before[i]
        left = h >= 0
        # To the right now, to the left, and to the right while what follows has not merged yet.
        same = np.full(len(i), rank, np.int32)
        a, b, c = np.split(self.ranks_of(
            np.concatenate((same, np.where(left, part[np.maximum(h, 0)], -1), same)),
            np.concatenate((np.where(inner, part[np.minimum(end, n)], 0), same, np.where(inner, passing, 0)))), 3)
        a, c = np.where(inner, a, -1), np.where(inner, c, -1)
        if any(((x >= 0) & (x < rank)).any() for x in (a, b, c)):
            part[i], part[j], after[i], waiting[j] = old_part, old_next, j, old_waiting
            before[end[inner]] = j[inner]
            return None
        waiting[j] = -1
        waiting[i] = a
        waiting[h[left]] = b[left]
        ranks, places = np.concatenate((a, b)), np.concatenate((i, h))
        order = np.argsort(ranks, kind="stable")
        order = order[int(np.searchsorted(ranks[order], 0)):]
        return ranks[order], places[order]

    def one_by_one(self, lists: Lists, rank: int, positions: list[int], queue: dict, top: int) -> int:
        """Merge at the positions of a bucket from the left; a lower rank that comes up goes first."""
        part, after, before, waiting = lists.cells
        n, known, pair = lists.n, self.pairs.get, self.pair
        pushes, lower = [], False
        for k, i in enumerate(positions):
            if waiting[i] != rank:
                continue  # stale
            j = after[i]
            after[i] = end = after[j]
            part[i] = rank
            part[j] = waiting[j] = waiting[i] = -1
            if end < n:
                before[end] = i
                r = known(rank << 20 | part[end])
                if r is None:
                    r = pair(rank, part[end])
                if r >= 0:
                    waiting[i] = r
                    pushes.append((r, i))
                    lower = r < rank
            h = before[i]
            if h >= 0:
                r = known(part[h] << 20 | rank)
                if r is None:
                    r = pair(part[h], rank)
                waiting[h] = r
                if r >= 0:
                    pushes.append((r, h))
                    lower = lower or r < rank
            if lower:
                pushes += [(rank, p) for p in positions[k + 1:] if waiting[p] == rank]
                break
        for r, i in pushes:
            bucket = queue.get(r)
            if bucket is None:
                queue[r] = [i]
                top = self.mark(r, top)
            else:
                bucket.append(i)
        return top


class Lists:
    """The parts of pre-tokens as linked lists in 32-bit cells: part, after, before, and the rank at which the pair that starts here waits."""

    def __init__(self, *columns: np.ndarray):
        self.n = len(columns[0])
        self.cells = [array("i", np.append(c, -1).astype(np.int32).tobytes()) for c in columns]
        self.part, self.after, self.before, self.waiting = (np.frombuffer(c, np.int32) for c in self.cells)


_encoders: dict[tuple, Encoder] = C.worker_tables.setdefault("bpe", {})


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` with the ids of ``text`` in a new column ``out`` (an array of int).

    With ``decoded``, the ids are decoded again in the same pass, into that column.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Vocabulary(load_ranks(spark, ranks_path)))
    key = (ranks_path, pattern)

    def run(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(held.value, pattern)
        for part in C.slices(batches, text, SLICE, keep="bpe"):
            ids, counts = _encoders[key].encode(part.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))
            added = [lists] if decoded is None else [lists, held.value.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    kept = docs.select(*C.others(docs.columns, out, *([decoded] if decoded else [])))
    added = [StructField(out, ArrayType(IntegerType())), *([StructField(decoded, BinaryType())] if decoded else [])]
    names = [*kept.columns, *(f.name for f in added)]
    return kept.mapInArrow(run, StructType([*kept.schema, *added]))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` with the bytes of ``ids`` in a new column ``out``."""
    spark = encoded.sparkSession
    held = spark.sparkContext.broadcast(Vocabulary(load_ranks(spark, ranks_path)))

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            values = held.value.decode(flat.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(lists.is_valid(), values, pa.scalar(None, pa.binary()))], names=names)

    kept = encoded.select(*C.others(encoded.columns, out))
    names = [*kept.columns, out]
    return kept.mapInArrow(run, StructType([*kept.schema, StructField(out, BinaryType())]))
