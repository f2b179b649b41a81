"""Indexes over passages that are aligned at their anchors, one column of the transform at a time.

The passages of a shard are written below each other so that their anchors stand in the same columns;
equal windows of passages of one anchor then begin in the same column. A symbol is a unit tagged with its
anchor and its column. The Burrows-Wheeler transform over such symbols falls into columns: the column of
place c lists, in the order of the suffixes from c + 1 on (anchor by anchor), the symbols before them. It
is built from right to left: sorting the suffixes that begin at c needs only the symbols at c and the
order of the suffixes from c + 1, so no suffix array of the whole is ever held.

Streaming a passage is backward search: the interval of the suffixes that begin with the units read so far
is narrowed by ranks in the column's transform, whose class is up to the operator. Once ``size`` units
are read, the interval is widened to the suffixes that share the next ``size`` units (the stretches
between neighbours whose common prefix is shorter): the match is then exactly a window, its length stays
at the threshold, and the earliest place in the interval is reported for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SYMBOL, _POSITION = 22, 20


class Passages:
    """Strings with their anchor's number (ascending), its place in the string and their number of windows."""

    def __init__(self, strings: pa.Array, words: bool, group: np.ndarray, at: np.ndarray, windows: np.ndarray):
        self.group, self.at, self.windows, self.count = group, at, windows, len(group)
        if words:
            ids: dict[bytes, int] = {}
            texts = [[ids.setdefault(w, len(ids) + 1) for w in s.split()] for s in strings.to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            symbols = np.fromiter((w for t in texts for w in t), np.int32, int(sizes.sum()))
        else:
            ends = np.frombuffer(strings.buffers()[1], np.int32 if strings.type == pa.binary() else np.int64, strings.offset + len(strings) + 1)[strings.offset:]
            symbols = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.int32) + 1
            sizes = np.diff(ends).astype(np.int64)
        if self.count >> _POSITION or (len(symbols) and int(symbols.max()) >> _SYMBOL) or int(group[-1]) >> 20:
            raise ValueError("an index holds at most 2^20 passages and 2^22 different units")
        self.middle = int(at.max())
        first = self.middle - at  # the column where each string begins
        self.width = int((first + sizes).max())
        owner = np.repeat(np.arange(self.count), sizes)
        column = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
        #: symbols[c, p]: of passage p at column c; 0 outside it.
        self.symbols = np.zeros((self.width, self.count), np.int32)
        self.symbols[column, owner] = symbols
        self.first = first


def earliest(passages: Passages, rank: np.ndarray, size: int, transform) -> np.ndarray:
    """[k, p]: the least rank of the passages that hold the k-th window of passage p (-1 where p has no k-th window).

    ``transform(ids, kinds, bounds, ranks)`` is the index of one column: ``ids`` the symbols before the
    suffixes in their order (0 to ``kinds`` - 1), ``bounds`` where the stretches of equal windows begin,
    ``ranks`` of the suffixes' passages. Its ``count(ids, ends)`` gives occurrences before ``ends``, its
    ``least()`` the least rank of each stretch.
    """
    m, group = passages.count, passages.group
    out = np.full((int(passages.windows.max()), m), -1, np.int64)
    if not m:
        return out
    bounds_of = np.searchsorted(group, np.arange(int(group[-1]) + 2))
    order = np.arange(m)  # passages in the order of their suffixes; here all are empty
    tagged = group.astype(np.int64) << (_SYMBOL + _POSITION) | np.arange(m)
    shared = np.zeros(m + 1, np.int64)  # units shared with the suffix before; one more for the end
    lo, hi = bounds_of[group], bounds_of[group + 1]
    depth = np.zeros(m, np.int64)
    bounds, stretch = np.arange(m), np.arange(m)
    for column in range(passages.width - 1, -2, -1):
        if column >= 0:
            symbols = passages.symbols[column]
            # Stable order of (anchor, symbol): the next column's order of suffixes.
            packed = tagged | symbols[order].astype(np.int64) << _POSITION
            packed.sort()
            moved = packed & ((1 << _POSITION) - 1)
            kind = packed >> _POSITION
            new = np.concatenate(([True], kind[1:] != kind[:-1]))
            begin = np.flatnonzero(new)
            ids = np.empty(m, np.int64)
            ids[moved] = np.cumsum(new) - 1
            kinds = len(begin)
        else:
            ids, kinds = np.zeros(m, np.int64), 1
        built = transform(ids, kinds, bounds, rank[order])
        window = column + 1 - passages.first
        ready = np.flatnonzero((depth >= size) & (window >= 0) & (window < passages.windows))
        if len(ready):
            out[window[ready], ready] = built.least()[stretch[lo[ready]]]
        if column < 0:
            return out
        # Backward search by one unit, for the passages that have one here.
        live = np.flatnonzero(symbols)
        own = np.empty(m, np.int64)
        own[order] = ids  # the symbol of each passage at this column
        symbol = own[live]
        lo[live] = begin[symbol] + built.count(symbol, lo[live])
        hi[live] = begin[symbol] + built.count(symbol, hi[live])
        depth[live] += 1
        # The order of the suffixes from this column on, and what neighbours share.
        least = np.minimum.reduceat(shared, moved + 1)
        shared = np.zeros(m + 1, np.int64)
        more = ~new[1:] & (kind[1:] & ((1 << _SYMBOL) - 1) > 0)
        shared[1:m] = np.where(more, least[:-1] + 1, 0)
        order = order[moved]
        # Matches longer than a window are cut to one.
        short = shared[:m] < size
        bounds, stretch = np.flatnonzero(short), np.cumsum(short) - 1
        wide = np.flatnonzero(depth > size)
        if len(wide):
            k = stretch[lo[wide]]
            lo[wide], hi[wide], depth[wide] = bounds[k], np.append(bounds[1:], m)[k], size
    return out
