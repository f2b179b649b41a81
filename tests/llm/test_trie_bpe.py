"""The trie of words against the tokenizers library, and against merging by the file's own order."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import trie_bpe
from tessera.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def file():
    return trie_bpe.parsed(json.load(open(PATH)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def merged(file, word):
    """Ids by plain merging, the earliest merge first."""
    rank = {(a, b): (r, t) for r, (a, b, t) in enumerate(file["merges"])}
    of = {t: i for i, t in enumerate(file["tokens"]) if t is not None}
    ids = [of[bytes([b])] for b in word]
    while True:
        found = min(((*rank[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), key=lambda x: (x[0], x[2]), default=None)
        if found is None:
            return ids
        ids[found[2]:found[2] + 2] = [found[1]]


def test_every_prefix_of_a_word_is_encoded_in_the_trie(file):
    trie = trie_bpe.Trie(trie_bpe.Merges(file["tokens"], file["merges"]))
    draw = random.Random(4)
    words = sorted({bytes(draw.choice(b"aabethinsor \xc3\xa9") for _ in range(draw.randrange(1, 14))) for _ in range(300)} | {b"aaaaaaa", b" the", b" there"})
    nodes = dict(zip(words, trie.insert(words), strict=True))
    assert all(trie.ids(n) == merged(file, w) for w, n in nodes.items())
    made = len(trie.token)
    prefixes = sorted({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert made == len(prefixes) + 1
    assert [trie.ids(n) for n in trie.insert(prefixes)] == [merged(file, p) for p in prefixes]
    assert len(trie.token) == made  # nothing was computed again


def test_tokens_encode_to_themselves(file):
    own = trie_bpe.Merges(file["tokens"], file["merges"]).own
    for t in random.Random(1).sample([t for t in file["tokens"] if t], 400):
        assert (t in own) == (merged(file, t) == [own.get(t)])


def test_small_vocabularies_with_equal_and_hidden_merges():
    """Runs of one letter (equal merges beside each other), and a token that its own bytes never give."""
    single = [bytes([b]) for b in range(256)]
    a, b, c = 97, 98, 99
    tokens = [*single, b"aa", b"ab", b"aab", b"aaaa", b"bc", b"abc"]
    merges = [(a, a, 256), (a, b, 257), (256, b, 258), (256, 256, 259), (b, c, 260), (257, c, 261)]
    file = {"tokens": tokens, "merges": merges, "special": {}}
    trie = trie_bpe.Trie(trie_bpe.Merges(tokens, merges))
    draw = random.Random(8)
    words = sorted({bytes(draw.choice(b"aaabc") for _ in range(draw.randrange(1, 12))) for _ in range(2000)})
    assert all(trie.ids(n) == merged(file, w) for w, n in zip(words, trie.insert(words), strict=True))


@pytest.mark.parametrize("change", [lambda m: m.update(merges=m["merges"][::-1]), lambda m: m.update(merges=m["merges"] + m["merges"][:1]), lambda m: m.update(byte_fallback=True)])
def test_other_files_are_refused(change):
    found = json.load(open(PATH))
    change(found["model"])
    with pytest.raises(ValueError):
        trie_bpe.Encoder(trie_bpe.parsed(found))


HARD = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "  two  spaces \n\n tabs\t\t", "don't 'RE we'll", "é 漢字 😀 ‍ x́", "a" * 5000, "-=" * 3000, "\x00\x85 　", "x" * 127 + "y", "x" * 129, "same", "same"]


def test_odd_texts(spark, library):
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("IDS", F.lit("taken")).withColumn("other", F.lit(1))
    path = f"file://{PATH}"
    got = trie_bpe.encode(rows, path)
    assert got.columns == ["doc_id", "text", "other", "ids"]
    for r in got.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    back = {r.doc_id: r.back for r in trie_bpe.decode(got, path, text="back").collect()}
    assert back == {k: t or "" for k, t in enumerate(HARD)}
    packed = trie_bpe.encode(rows, path, packed=True)
    assert {r.doc_id: r.back for r in trie_bpe.decode(packed, path, text="back").collect()} == back
    assert trie_bpe.encode(rows.where("false"), path, decoded="again").count() == 0
    ids = spark.createDataFrame([(1, None), (2, [50256, 128])], "k int, ids array<int>")
    assert {r.k: r.text for r in trie_bpe.decode(ids, path).collect()} == {1: None, 2: library.decode([50256, 128], skip_special_tokens=False)}
    with pytest.raises(Exception, match="no token has the id"):
        trie_bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), path).collect()


def test_a_full_trie_begins_anew(file, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "NODES", 50)
    encoder, draw = trie_bpe.Encoder(file), random.Random(2)
    for _ in range(20):
        text = " ".join("".join(draw.choice("abethr") for _ in range(8)) for _ in range(10))
        assert np.frombuffer(encoder([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.trie.token) < 200


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_trie_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
