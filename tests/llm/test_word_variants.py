"""Near words, forms and roots against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import word_variants

WORDS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(texts, slip, shortest=5, least=3, times=2):
    counts = Counter()
    for i, t in texts:
        for run in WORDS.findall(t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    out = {}
    for w, n in words.items():
        beside = [(-m, v) for v, m in words.items() if near(w, v)]
        m, form = min(beside, default=(0, None))
        out[w] = [n, len(beside), *((form, -m) if form and -m >= times * n else (None, None))]
    for w, found in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        found.append(root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("slip", [None, 3, 97])
def test_variants(spark, slip):
    draw = random.Random(6)
    base = ["spelling", "spellling", "speling", "aaaaa", "aaaaaa", "été", "étéété", "étÉété", "banana", "bananas", "bannana", "Straße", "strasse"]
    pool = base + [w[:k] + draw.choice("abÉ×") + w[k + draw.choice([0, 1]):] for w in base for k in range(len(w))]
    weights = [draw.choice([1, 2, 8, 40]) for _ in pool]
    texts = [(draw.choice([None, k]), draw.choice([" ", "-", "1"]).join(draw.choices(pool, weights, k=60))) for k in range(40)]
    texts += [(7, None), (8, ""), (9, "SPELLING " * 300), texts[0], texts[0]]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("taken")).withColumn("N", F.lit(1))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in word_variants.variants(rows, slip=slip).collect()}
    want = brute(texts, slip)
    assert got == want and any(v[4] != v[2] and v[2] for v in want.values())
    assert word_variants.variants(rows.where("false"), slip=slip).count() == 0


def test_a_long_chain_of_forms(spark):
    chain = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(37)] + [("x", "w30"), ("y", "z")], "word string, form string")
    assert {r.word: r.root for r in word_variants.roots(chain).collect()} == {**{f"w{k:02}": "w37" for k in range(37)}, "x": "w37", "y": "z"}


def test_groups_tell_sizes_and_no_pairs_are_made(spark):
    """A position where all words differ: each has as many near words as there are others, from one group."""
    rows = [(f"wo{c}ds", n) for n, c in enumerate("abcdefghij", 1)]
    got = {r.word: (r.n_near, r.best.m, r.best.word) for r in word_variants.near(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {w: (9, *((-10, "wojds") if w != "wojds" else (-9, "woids"))) for w, _ in rows}
