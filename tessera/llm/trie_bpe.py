"""Byte-level BPE over a trie of words: encodings of shared prefixes are computed once.

Whatever a word is encoded to, the encoding of each of its prefixes ends in one token, and without that token it is
the encoding of a shorter prefix. So a node of a trie of words needs two numbers: its prefix's last token, and the
node where that token begins. Distinct words are inserted in sorted order, which makes the nodes depth first; when a
node is made, its last token is the one among the vocabulary's tokens that end there which (a) encodes to itself and (b)
stays apart from the last token of the node where it begins. A word's encoding is read back from its node.

Two adjacent tokens stay apart if no merge across their border comes before the merges that make them: of both, the
parts beside the border are walked from bytes upwards, each in the order of the merges (``Merges.apart``). A token
encodes to itself if its two parts do and stay apart until they are merged. This needs merges whose parts were made by
earlier merges, as training gives them, and one merge per token; other files are refused.

Encoding is a map over documents: nothing is shuffled. The tokenizer's file (at most ``FILE_BYTES``, checked) is
broadcast. A worker keeps its trie and the encodings of its words for the next slice, up to ``NODES`` nodes; then it
begins anew. Words of more than ``LONG`` bytes are walked by the same rule but not kept.

Texts are first cut at the file's special tokens, as the library does by default, then by the pattern.

Defined results: null texts are empty; an empty text has no ids and decodes to the empty text; null lists of ids stay
null; ids unknown to the file fail; bytes that are no UTF-8 decode to U+FFFD; empty tables give no rows; columns named as
the results (in any case) are replaced, others pass through.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from . import common as C
from .bpe import splitter

FILE_BYTES = 64 << 20
#: Nodes that a worker keeps (with their words about 250 bytes each), bytes of a word that is kept, pairs of tokens that are remembered.
NODES, LONG, PAIRS = 1 << 20, 128, 1 << 20
#: Lengths of tokens that are looked for after any bytes; the last one is always found.
SHORT = (3, 2, 1)
SLICE = 1 << 21
#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a byte-level file writes as the character of the same number; the others follow from 256 on.
SAME = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of() -> dict[str, int]:
    """Characters of a byte-level file and the bytes that they stand for."""
    rest = [b for b in range(256) if b not in SAME]
    return {chr(b): b for b in SAME} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(spark, path: str) -> dict:
    """Tokens by id (bytes), merges in their order and special tokens, read through Spark; the size is checked."""
    found = spark.read.format("binaryFile").load(path)
    size = found.agg(F.sum("length")).first()[0]
    if size > FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {FILE_BYTES}")
    return parsed(json.loads(bytes(found.select("content").first()[0])))


def parsed(file: dict) -> dict:
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE file: {odd or pre or model.get('type')}")
    special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    if any(t.get(k) for t in file.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("special tokens must be taken as they are")
    code = byte_of()
    raw = {t: bytes(code[c] for c in t) for t in model["vocab"]}
    tokens: list[bytes | None] = [None] * (1 + max([*model["vocab"].values(), *special.values()]))
    for t, i in model["vocab"].items():
        tokens[i] = raw[t]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
    return {"tokens": tokens, "merges": merges, "special": special}


class Merges:
    """The order of merges, and whether adjacent tokens stay apart."""

    def __init__(self, tokens: list[bytes | None], merges: list[tuple[int, int, int]]):
        self.last = len(merges)  # later than all merges
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made = {t: r for r, (_, _, t) in enumerate(merges)}
        self.parts = {t: (a, b) for a, b, t in merges}
        single = {i for i, t in enumerate(tokens) if t is not None and len(t) == 1}
        early = lambda t, r: t in single or self.made.get(t, self.last) < r
        if len(self.made) < len(merges) or not all(early(a, r) and early(b, r) for r, (a, b, _) in enumerate(merges)):
            raise ValueError("merges must be given in the order of training, one for each token")
        if len(single) < 256:
            raise ValueError("no token spells some byte")
        self.kept: dict[tuple[int, int], bool] = {}
        own = set(single)
        for t, (a, b) in self.parts.items():
            if a in own and b in own and self._walk(a, b, self.made[t]):
                own.add(t)
        #: Tokens that encode to themselves.
        self.own = {tokens[i]: i for i in own}

    def _walk(self, a: int, b: int, until: int) -> bool:
        """Whether no merge takes place across the border of a and b before merge ``until``.

        Parts beside the border are followed from bytes upwards; the earlier one is merged first. Of equal merges the left
        one is first: the one within a goes before the one across, that one before the one within b.
        """
        left, right = [a], [b]
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][1])
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][0])
        while True:
            ends = self.made[left[-2]] if len(left) > 1 else until, self.made[right[-2]] if len(right) > 1 else until
            across = self.rank.get((left[-1], right[-1]), until)
            if across < ends[0] and across <= ends[1] and across < until:
                return False
            if len(left) == len(right) == 1:
                return True
            (left if len(right) == 1 or len(left) > 1 and ends[0] <= ends[1] else right).pop()

    def apart(self, a: int, b: int) -> bool:
        known = self.kept.get((a, b))
        if known is None:
            if len(self.kept) >= PAIRS:
                self.kept.clear()
            known = self.kept[a, b] = self._walk(a, b, self.last)
        return known


class Trie:
    """Nodes with the last token of their prefix and the node where it begins; the root is 0."""

    def __init__(self, merges: Merges, tails: dict[bytes, tuple] | None = None):
        self.merges = merges
        #: Lengths that tokens with these last four bytes have, the longest first, then the shorter ones.
        self.tails = self._lengths() if tails is None else tails
        self.clear()

    def _lengths(self) -> dict[bytes, tuple]:
        found: dict[bytes, set[int]] = {}
        for token in self.merges.own:
            if len(token) > 3:
                found.setdefault(token[-4:], set()).add(len(token))
        return {tail: (*sorted(lengths, reverse=True), *SHORT) for tail, lengths in found.items()}

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.token, self.begin = array("i", [-1]), array("i", [0])

    def insert(self, words: list[bytes]):
        """Node of each word; words are sorted, so that nodes are made depth first."""
        path, before = [0], b""
        ahead, token, begin, own, tails, apart = self.next, self.token, self.begin, self.merges.own, self.tails, self.merges.apart
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del path[same + 1:]
            node = path[-1]
            for end in range(same + 1, len(word) + 1):
                step = node << 8 | word[end - 1]
                node = ahead.get(step)
                if node is None:
                    # The prefix's last token: it ends here, and stays apart from the last token before it.
                    for size in tails.get(word[end - 4:end], SHORT) if end > 3 else SHORT:
                        last = own.get(word[end - size:end]) if size <= end else None
                        if last is not None and (size == end or apart(token[path[end - size]], last)):
                            break
                    node = ahead[step] = len(token)
                    token.append(last)
                    begin.append(path[end - size])
                path.append(node)
            before = word
            yield node

    def ids(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.token[node])
            node = self.begin[node]
        return out[::-1]


class Encoder:
    """Texts to ids, with a trie that is kept from call to call."""

    def __init__(self, file: dict):
        self.trie = Trie(Merges(file["tokens"], file["merges"]))
        self.special = {t: i.to_bytes(4, "little") for t, i in file["special"].items()}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split, self.words = splitter(PATTERN), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        pieces = []
        for text in texts:
            if self.cut is None or not self.cut.search(text):
                pieces.append((None, self.split(text)))
                continue
            parts, at = [], 0
            for found in self.cut.finditer(text):
                parts += [(None, self.split(text[at:found.start()])), (found.group(), [])]
                at = found.end()
            pieces.append((parts, self.split(text[at:])))
        lists = [p for parts, tail in pieces for p in (*(x for _, x in parts or ()), tail)]
        self._learn({w for p in lists for w in p})
        coded = lambda p: b"".join([self.words[w] for w in p])
        return [b"".join([coded(p) if mark is None else self.special[mark] for mark, p in parts or ()]) + coded(tail) for parts, tail in pieces]

    def _learn(self, words: set[str]) -> None:
        if len(self.trie.token) > NODES:
            self.trie.clear()
            self.words = {}
        new = sorted((w.encode(), w) for w in words if w not in self.words)
        short = [x for x in new if len(x[0]) <= LONG]
        for (_, w), node in zip(short, self.trie.insert([raw for raw, _ in short]), strict=True):
            self.words[w] = array("i", self.trie.ids(node)).tobytes()
        for raw, w in new:
            if len(raw) > LONG:
                alone = Trie(self.trie.merges, self.trie.tails)
                self.words[w] = array("i", alone.ids(*alone.insert([raw]))).tobytes()

    def forget_long(self) -> None:
        """Let go of words that are not kept."""
        for w in [w for w in self.words if len(w) > LONG // 4 and len(w.encode()) > LONG]:
            del self.words[w]


class Decoder:
    def __init__(self, file: dict):
        self.tokens = list(file["tokens"])
        for text, i in file["special"].items():
            self.tokens[i] = text.encode()

    def __call__(self, ids: list[int]) -> str:
        for i in ids:
            if not 0 <= i < len(self.tokens) or self.tokens[i] is None:
                raise ValueError(f"no token has the id {i}")
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


def _coder(shared, kind):
    """The worker's encoder or decoder of this file."""
    kept = C.worker_tables.setdefault("trie_bpe", {})
    if kept.get("of") != shared.value[0]:
        kept.clear()
        kept["of"] = shared.value[0]
    if kind not in kept:
        kept[kind] = kind(shared.value[1])
    return kept[kind]


def _shared(spark, path: str):
    return spark.sparkContext.broadcast((f"{path} {C.uuid.uuid4().hex}", load(spark, path)))


def encode(docs: DataFrame, path: str, text: str = "text", packed: bool = False, decoded: str | None = None) -> DataFrame:
    """Documents with ``ids`` (``packed``: as little-endian 32-bit integers in one binary), and their decoded text on request."""
    shared = _shared(docs.sparkSession, path)
    keep = C.others(docs.columns, "ids", *([decoded] if decoded else []))
    fields = [docs.schema[c] for c in keep] + [StructField("ids", BinaryType() if packed else ArrayType(IntegerType()))] + ([StructField(decoded, StringType())] if decoded else [])

    def run(batches):
        for part in C.slices(batches, text, SLICE, "trie_bpe"):
            encoder = _coder(shared, Encoder)
            ids = encoder([t or "" for t in part.column(text).to_pylist()])
            encoder.forget_long()
            counts = np.array([len(x) for x in ids]) // 4
            flat = np.frombuffer(b"".join(ids), "<i4")
            arrays = [part.column(c) for c in keep]
            arrays.append(pa.array(ids, pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat)))
            if decoded:
                decoder = _coder(shared, Decoder)
                arrays.append(pa.array([decoder(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, StructType(fields))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with the text of their ids (a list, or packed)."""
    shared = _shared(rows.sparkSession, path)
    keep = C.others(rows.columns, text)
    packed = isinstance(rows.schema[ids].dataType, BinaryType)

    def run(batches):
        for part in batches:
            decoder = _coder(shared, Decoder)
            lists = [None if x is None else np.frombuffer(x, "<i4").tolist() if packed else x for x in part.column(ids).to_pylist()]
            texts = pa.array([None if x is None else decoder(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], names=[*keep, text])

    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField(text, StringType())]))
