"""Substring dedup: a compressed FM-index per shard, its transform held in wavelet trees.

Documents lose every word that lies in a run of ``SIZE`` words which an earlier document also has. The
frame in ``passages`` brings together what can match; each shard builds the FM-index of its passages
(``aligned``: a transform column is a wavelet tree over its words, and each stretch of equal windows keeps
the first of its documents) and streams every passage against it. Backward search narrows an interval of
suffixes word by word; matches of ``SIZE`` words are reported with the first document that holds them, and
windows that an earlier document holds are removed, in whichever document the passage occurs. No suffix
array is kept.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows
with equal ids never remove each other's words; rows with a null id lose and remove nothing; other
columns pass through (but for those named as the results, in any case); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import passages
from .passages import Units

SIZE = 50
GRAM = 16


class WaveletTree:
    """Rank over a sequence of symbols: one packed bit vector per level, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        n, row = len(symbols), symbols
        self.words, self.counts, self.zeros = [], [], []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            packed = np.zeros((n >> 6) + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(ones)[:-1])))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate((row[~bit], row[bit]))
        self.shifts = list(range(len(self.words) - 1, -1, -1))

    def place(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes after all levels, following the bits of its symbol."""
        for words, counts, zeros, shift in zip(self.words, self.counts, self.zeros, self.shifts, strict=True):
            block = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            i = np.where(symbols >> shift & 1, zeros + ones, i - ones)
        return i


class FMColumn:
    """A column of the transform: a wavelet tree, and the first document of every stretch of equal windows."""

    def __init__(self, ids: np.ndarray, kinds: int, bounds: np.ndarray, ranks: np.ndarray):
        self.tree = WaveletTree(ids, kinds - 1)
        self.begin = self.tree.place(np.arange(kinds), np.zeros(kinds, np.int64))
        self.documents = np.minimum.reduceat(ranks, bounds)

    def count(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position ``ends``."""
        return self.tree.place(ids, ends) - self.begin[ids]

    def least(self) -> np.ndarray:
        return self.documents


def units(size: int = SIZE, gram: int = GRAM) -> Units:
    return Units(words=True, size=size, gram=min(gram, size), within=False)


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, spans (word ranges) that an earlier document also has."""
    return passages.spans(docs, units(size, gram), FMColumn)


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs`` with kept (the words left), n_units, n_removed, n_spans."""
    return passages.remove(docs, repeated_spans(docs, size, gram), units(size, gram))
