"""Suffix dedup of bytes by a run-length index.

Texts lose every byte that lies in a string of ``SIZE`` bytes which also starts earlier (in a document
with a smaller id, or earlier in the same one). The frame in ``passages`` brings together what can
match; each shard builds the Burrows-Wheeler transform of its passages (``aligned``) and keeps the runs of
its columns only: their starts, symbols and counts per symbol give rank, and a suffix sampled at each run
gives its places. Matching statistics are streamed by backward search: every passage is read against the
index, and each window of it gets the earliest place that holds it.

A run's sample is the earliest of its suffixes, and a run ends where the next window differs, as places
are asked for in order, not just any.

Defined results: null is empty; texts shorter than ``SIZE`` bytes lose nothing; of rows with equal ids
and equal texts each loses what repeats within it, and what starts in smaller ids; rows with a null id
lose and remove nothing; other columns pass through (but for those named as the results, in any case);
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import passages
from .passages import Units

SIZE = 100
GRAM = 32


class RunColumn:
    """A column of the transform by its runs, each with the earliest place among its suffixes."""

    def __init__(self, ids: np.ndarray, kinds: int, bounds: np.ndarray, ranks: np.ndarray):
        self.n = len(ids)
        new = np.concatenate(([True], ids[1:] != ids[:-1]))
        new[bounds] = True
        starts = np.flatnonzero(new)
        self.samples = np.minimum.reduceat(ranks, starts)
        self.stretches = np.searchsorted(starts, bounds)
        keys = ids[starts] * (self.n + 1) + starts
        order = np.argsort(keys)
        self.keys = keys[order]
        self.starts, self.symbols = starts[order], ids[starts][order]
        self.lengths = np.diff(np.append(starts, self.n))[order]
        total = np.cumsum(self.lengths) - self.lengths
        self.counts = total - total[np.searchsorted(self.symbols, self.symbols)]

    def count(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position ``ends``, from the runs."""
        run = np.searchsorted(self.keys, ids * (self.n + 1) + ends) - 1
        inside = np.minimum(ends - self.starts[run], self.lengths[run])
        return np.where((run >= 0) & (self.symbols[run] == ids), self.counts[run] + inside, 0)

    def least(self) -> np.ndarray:
        """The earliest place of each stretch of equal windows, from the samples of its runs."""
        return np.minimum.reduceat(self.samples, self.stretches)


def units(size: int = SIZE, gram: int = GRAM) -> Units:
    return Units(words=False, size=size, gram=min(gram, size), within=True)


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, spans (byte ranges) that also start earlier."""
    return passages.spans(docs, units(size, gram), RunColumn)


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs`` with kept (the bytes left, binary), n_units, n_removed, n_spans."""
    return passages.remove(docs, repeated_spans(docs, size, gram), units(size, gram))
