"""Toxicity by a linear-chain conditional random field over words.

Documents have labels, words do not; words are labelled from them: in a toxic document, a word is
toxic if one of its features (the word, its beginnings, its end) is far more frequent in toxic
documents than in others. Uses with the same neighbouring words count once, so that the words of
copies and of repeated passages do not pass for toxic. A two-state chain is fitted to these words by maximum likelihood
(forward-backward gives the gradient), and a document's word marginals are summed up (expected number
of toxic words, largest marginal, share) in a logistic score. Words that are likelier toxic than not
are reported with their byte offsets in the text.

A chain covers all words of a document. Its messages are computed block by block for both states that can
enter and leave a block, then carried from block to block, which is exact and takes steps of all
documents at once.

Fitting takes at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other labelled documents (in the order of a
hash of the id, as long as their texts have at most ``FIT_BYTES`` together; a text that no longer fits is
passed over), on the driver; scoring is a map over all whole texts: no shuffle, memory of one slice. Labels,
language, source and id are never inputs of a score.

Defined results: null and empty texts have no words and get the score of a document without toxic
words; without labelled documents of both kinds every score is the share of toxic labels (0 if none);
a null id is in no fold and not held out; of repeated labels of one id, and of labels of equal texts, the
largest counts; columns of the documents pass through ``keep_clean``, and empty tables give no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TOXIC_ROWS, CLEAN_ROWS, FIT_BYTES = 800, 1400, 8 << 20
#: Words of a chain that are computed in one piece, and pieces that are held at once.
BLOCK, HELD = 64, 2048
#: Bytes of a word's beginnings that are features, besides the word and its last four bytes.
HEADS = (4, 5, 6, 7, 8)
#: A feature marks words as toxic if toxic documents use it this many times as often as others.
ODDS = 20.0
ROUNDS = 40
#: Marginals that count towards the expected number of toxic words.
LEAST = 0.1

SCORES = "doc_id long, n_words long, n_toxic long, expected double, score double, spans array<struct<start:int,stop:int>>"


def folded(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def feature(words: C.Words, kind: int) -> np.ndarray:
    """Hashes of one feature of every word: the word, its last four bytes, or one of its beginnings (0 if it is no longer); kinds hash apart."""
    starts, ends = words.starts, words.ends
    if kind > 1:
        size = HEADS[kind - 2]
        out = np.where(ends - starts > size, words.spans(starts, np.minimum(starts + size, ends)), np.uint64(0))
    else:
        out = words.spans(np.maximum(starts, ends - 4) if kind else starts, ends)
    return C.mix(out + np.uint64(kind + 1)) if kind else out


KINDS = range(2 + len(HEADS))


def features(words: C.Words) -> np.ndarray:
    return np.stack([feature(words, k) for k in KINDS])


@functools.cache
def _resized() -> re.Pattern:
    """Characters that have another number of bytes in lower case (none beyond this range is cased)."""
    cased = (c for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F000)]) if c.lower() != c)
    return re.compile("([" + "".join(re.escape(c) for c in cased if len(c.lower().encode()) != len(c.encode())) + "])")


def lowered(texts: list[str | None]) -> list[bytes]:
    """Lower-cased texts in which every word stands where it does in the text: characters whose size would change stay."""
    out = []
    for t in texts:
        t = t or ""
        if t.isascii() or not _resized().search(t):
            low = t.lower()
        else:
            low = "".join([p if k % 2 else p.lower() for k, p in enumerate(_resized().split(t))])
        out.append(low.encode("utf-8", "replace"))
    return out


class Chain:
    """Two states per word; ``weights`` of known features and a bias give the toxic state's lead."""

    def __init__(self, known: np.ndarray):
        self.known, self.weights, self.bias = known, np.zeros(len(known) + 1), -4.0
        self.moves = np.zeros((2, 2))  # from, to

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """Places of features in ``known``; the last place stands for unknown ones."""
        if not len(self.known):
            return np.zeros(hashes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, len(self.known)).astype(np.int32)

    def leads(self, columns: np.ndarray) -> np.ndarray:
        return sum((self.weights[c] for c in columns), np.full(columns.shape[1], self.bias))

    def marginals(self, lead: np.ndarray, first: np.ndarray, joint: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over the chains of texts whose words begin at ``first``: P(toxic) of every word, sums of pair marginals (``joint``)."""
        out, pairs = np.zeros(len(lead)), np.zeros((2, 2))
        ends = np.cumsum(-(-np.diff(first) // BLOCK))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, "right")))
            a, b = first[start], first[stop]
            if b > a:
                out[a:b], more = self._marginals(lead[a:b], first[start:stop + 1] - a, joint)
                pairs += more
            start = stop
        return out, pairs

    def _marginals(self, lead: np.ndarray, first: np.ndarray, joint: bool) -> tuple[np.ndarray, np.ndarray]:
        move, counts = np.exp(self.moves), np.diff(first)
        number = -(-counts // BLOCK)
        begin = np.repeat(first[:-1], number) + C.ranges(np.zeros(len(number), np.int64), number) * BLOCK
        size = np.minimum(BLOCK, np.repeat(first[1:], number) - begin)
        head = (np.cumsum(number) - number)[number > 0]  # the first block of each text
        number = number[number > 0]
        n, length = len(begin), int(size.max())
        inside = np.arange(length)[:, None] < size[None, :]
        factor = np.where(inside, np.exp(np.clip(lead, -30, 30))[np.minimum(begin[None, :] + np.arange(length)[:, None], len(lead) - 1)], 1.0)
        m00, m01, m10, m11 = move.ravel().tolist()
        # ahead[2 * entering state + state, t, block], back[2 * state + leaving state, t, block], up to a factor each.
        ahead, back = np.empty((4, length, n)), np.empty((4, length, n))
        x = np.ones(n), np.zeros(n), np.zeros(n), factor[0]
        for t in range(length):
            if t:
                f = factor[t]
                x = x[0] * m00 + x[1] * m10, (x[0] * m01 + x[1] * m11) * f, x[2] * m00 + x[3] * m10, (x[2] * m01 + x[3] * m11) * f
                scale = 1 / (x[0] + x[1] + x[2] + x[3])
                x = x[0] * scale, x[1] * scale, x[2] * scale, x[3] * scale
            ahead[0, t], ahead[1, t], ahead[2, t], ahead[3, t] = x
        short = np.flatnonzero(size < length)
        x = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
        for t in range(length - 1, -1, -1):
            if t < length - 1:
                f = factor[t + 1]
                u, v = x[2] * f, x[3] * f
                x = m00 * x[0] + m01 * u, m00 * x[1] + m01 * v, m10 * x[0] + m11 * u, m10 * x[1] + m11 * v
                scale = 1 / (x[0] + x[1] + x[2] + x[3])
                x = x[0] * scale, x[1] * scale, x[2] * scale, x[3] * scale
                over = short[size[short] <= t + 1]
                if len(over):
                    x[0][over] = x[3][over] = 1.0
                    x[1][over] = x[2][over] = 0.0
            back[0, t], back[1, t], back[2, t], back[3, t] = x
        # What enters and leaves each block, carried through the texts.
        enter, leave, ended = np.ones((2, n)), np.ones((2, n)), np.zeros((2, n))
        for k in range(int(number.max())):
            own = head[number > k] + k
            if k:
                enter[:, own] = move.T @ ended[:, own - 1]
            last = ahead[:, size[own] - 1, own]
            out = np.stack((enter[0, own] * last[0] + enter[1, own] * last[2], enter[0, own] * last[1] + enter[1, own] * last[3]))
            ended[:, own] = out / out.sum(axis=0)
        for k in range(int(number.max()) - 2, -1, -1):
            own = head[number > k + 1] + k
            b, after = back[:, 0, own + 1], leave[:, own + 1]
            begun = move @ np.stack((b[0] * after[0] + b[1] * after[1], (b[2] * after[0] + b[3] * after[1]) * factor[0, own + 1]))
            leave[:, own] = begun / begun.sum(axis=0)
        clean, toxic = enter[0] * ahead[0] + enter[1] * ahead[2], enter[0] * ahead[1] + enter[1] * ahead[3]
        right, wrong = leave[0] * back[0] + leave[1] * back[1], leave[0] * back[2] + leave[1] * back[3]
        del ahead, back
        marginal = toxic * wrong / (clean * right + toxic * wrong)
        if not joint:
            return marginal.T[inside.T], np.zeros((2, 2))
        # Pairs of neighbours: within a block, and across into the next one.
        later = np.setdiff1d(np.arange(n), head)
        first_of = np.zeros((2, 1, n))
        first_of[:, 0, later] = ended[:, later - 1]
        before = [np.concatenate((first_of[k], x[:-1])) for k, x in enumerate((clean, toxic))]
        wrong *= factor
        cells = [[before[0] * m00 * right, before[0] * m01 * wrong], [before[1] * m10 * right, before[1] * m11 * wrong]]
        total = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
        share = np.where(inside & (total > 0), 1 / np.maximum(total, 1e-300), 0.0)
        return marginal.T[inside.T], np.array([[float((c * share).sum()) for c in row] for row in cells])

    def words(self, columns: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of every word of a slice; texts begin at ``first``."""
        return self.marginals(self.leads(columns), first, joint=False)[0]


def summaries(toxic: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: a constant, log of the expected number of toxic words, largest marginal, root of their share."""
    # Marginals below LEAST are the background of a long text, not words that may be toxic.
    total = np.concatenate(([0.0], np.cumsum(np.where(toxic >= LEAST, toxic, 0.0))))
    expected = np.maximum(total[first[1:]] - total[first[:-1]], 0)
    counts = np.diff(first)
    largest = np.zeros(len(counts))
    some = np.flatnonzero(counts)
    if len(some):
        largest[some] = np.maximum.reduceat(toxic, first[some])
    return np.stack([np.ones(len(counts)), np.log1p(expected), largest, np.sqrt(expected / np.maximum(counts, 1))], axis=1)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    return a[new], b[new]


class Model:
    """A chain and the logistic weights of document summaries."""

    def __init__(self, texts: list[str], toxic: np.ndarray, share: float):
        """``share``: of toxic ones among all labelled documents, of which these are more even a sample."""
        self.chain, self.logistic, self.share = Chain(np.empty(0, np.uint64)), None, share
        if 0 < toxic.sum() < len(toxic):
            self._fit(texts, toxic)

    def _fit(self, texts: list[str], toxic: np.ndarray) -> None:
        # Words in slices; their features are made kind by kind, whenever they are needed.
        coded = lowered(texts)
        ends = np.cumsum([len(t) for t in coded])
        parts, uses = [], []
        start = 0
        while start < len(coded):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
            words = C.Words(coded[start:stop], C.PLAIN)
            own = feature(words, 0)
            # A use of a feature: with its neighbouring words. Repeated passages have no more uses than one.
            near = np.concatenate((own[-1:], own, own[:1])) if len(own) else np.empty(2, np.uint64)
            place = C.mix(near[:-2] + C.mix(near[1:-1] + C.mix(near[2:])))
            owner = np.repeat(np.arange(start, stop), words.counts())
            uses.append(place >> np.uint64(1) | (toxic[owner] > 0).astype(np.uint64) << np.uint64(63))
            words.forget()
            parts.append(words)
            start = stop
        del coded
        counts, uses = np.concatenate([w.counts() for w in parts]), np.concatenate(uses)
        def of_kind(kind):
            out = []
            for w in parts:
                out.append(feature(w, kind))
                w.forget()
            return np.concatenate(out)

        first = np.concatenate(([0], np.cumsum(counts)))
        doc = np.repeat(np.arange(len(texts)), counts)
        # Of each feature, how many different uses documents of either kind have.
        known, bad, good = [], [], []
        for k in KINDS:
            flat, use = unique_pairs(of_kind(k), uses)
            names, at = np.unique(flat, return_inverse=True)
            ill = np.bincount(at, weights=use >> np.uint64(63), minlength=len(names))
            known.append(names)
            bad.append(ill)
            good.append(np.bincount(at, minlength=len(names)) - ill)
            del flat, use, at
        del uses
        known, at = np.unique(np.concatenate(known), return_inverse=True)
        bad, good = (np.bincount(at, weights=np.concatenate(x), minlength=len(known)) for x in (bad, good))
        n_bad, n_good = bad.sum(), good.sum()
        odds = ((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1))
        marks = known[(odds >= ODDS) & (bad >= max(5, 0.01 * toxic.sum())) & (known != 0)]
        kept = known[(bad + good >= 4) & ((odds >= 2) | (odds <= 0.5)) & (known != 0)]
        self.chain = chain = Chain(kept)
        truth = np.zeros(len(doc), bool)
        columns = np.empty((len(KINDS), len(doc)), np.int32)
        for k in KINDS:
            row = of_kind(k)
            truth |= np.isin(row, marks)
            columns[k] = chain.columns(row)
        truth &= toxic[doc] > 0
        del parts, row, doc
        self._maximise(chain, columns, first, truth)
        marginal = chain.words(columns, first)
        sampled = toxic.mean()
        weight = np.where(toxic > 0, self.share / sampled, (1 - self.share) / (1 - sampled))
        self.logistic = logistic(summaries(marginal, first), toxic, weight)

    @staticmethod
    def _maximise(chain: Chain, columns: np.ndarray, first: np.ndarray, truth: np.ndarray) -> None:
        """Regularised maximum likelihood by adaptive gradient steps over all chains."""
        inner = np.ones(len(truth), bool)
        inner[first[:-1][first[:-1] < len(truth)]] = False  # words that follow another one of their text
        follow = np.flatnonzero(inner)
        seen_pairs = np.bincount(truth[follow - 1] * 2 + truth[follow], minlength=4).reshape(2, 2)
        spread = [np.full(len(chain.weights), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
        for _ in range(ROUNDS):
            found, pairs = chain.marginals(chain.leads(columns), first)
            miss = truth - found
            step = sum((np.bincount(c, weights=miss, minlength=len(chain.weights)) for c in columns), -0.05 * chain.weights)
            step[-1] = 0.0
            moves = seen_pairs - pairs - 0.05 * chain.moves
            bias = miss.sum()
            spread[0] += step ** 2
            spread[1] += bias ** 2
            spread[2] += moves ** 2
            chain.weights += 0.5 * step / np.sqrt(spread[0])
            chain.bias += 0.5 * bias / np.sqrt(spread[1])
            chain.moves += 0.2 * moves / np.sqrt(spread[2])

    def score(self, summary: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(summary), self.share)
        return 1 / (1 + np.exp(-np.clip(summary @ self.logistic, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method; rows count by their weight."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold, within the bounds above."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic")).where(folded(F.col("id")) != 0)
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    order = (F.xxhash64("id"), "id")
    chosen = None
    for value, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        part = known.where((F.col("toxic") > 0) == bool(value)).orderBy(*order).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(chosen), "id")
    # Sizes first: the texts that are taken have FIT_BYTES at most.
    sizes = sorted((r.place, r.id, r.size) for r in texts.groupBy("id").agg(F.max(F.octet_length("text")).alias("size"), F.count("*").alias("n")).select("id", F.xxhash64("id").alias("place"), (F.col("size") * F.col("n")).alias("size")).collect())
    total, taken = 0, []
    for _, i, size in sizes:
        if total + size <= FIT_BYTES:
            total += size
            taken.append((i,))
    if not taken:
        return Model([], np.empty(0), float(share))
    own = F.broadcast(docs.sparkSession.createDataFrame(taken, "id long"))
    rows = texts.join(own, "id").groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r.id, r.text))
    model = Model([r.text for r in rows], np.array([float(r.toxic > 0) for r in rows]), float(share))
    del rows
    C.give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: words, words likelier toxic than not and their byte offsets, expected number, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for part in C.slices(batches, "text"):
            texts = lowered(part.column("text").to_pylist())
            words, toxic, values, summary = _scored(held.value, texts)
            hits = np.flatnonzero(toxic > 0.5)
            cut = np.searchsorted(hits, words.first)
            spans = pa.array([[{"start": int(words.starts[h] - words.text_starts[d]), "stop": int(words.ends[h] - words.text_starts[d])} for h in hits[cut[d]:cut[d + 1]]] for d in range(len(texts))], kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts()), pa.array(np.diff(cut)), pa.array(np.expm1(summary[:, 1])), pa.array(values), spans], ["doc_id", "n_words", "n_toxic", "expected", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def _scored(model: Model, texts: list[bytes]):
    words = C.Words(texts, C.PLAIN)
    toxic = model.chain.words(model.chain.columns(features(words)), words.first) if len(words.starts) else np.empty(0)
    summary = summaries(toxic, words.first)
    return words, toxic, model.score(summary), summary


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in C.slices(batches, "text"):
            values = _scored(held.value, lowered(part.column("text").to_pylist()))[2]
            yield part.filter(pa.array(values < threshold))

    return docs.mapInArrow(run, docs.schema)
