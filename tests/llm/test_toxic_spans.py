"""Toxicity against what was planted: held-out documents, the words in them and their byte offsets; nothing of the operator's own scoring is used."""

import random
import re
import zlib

import pytest

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(draw.randrange(3, 9)))
    clean, bad = [word() for _ in range(400)], ["vexgrumly", "blortaker", "snärvikisch", "quogzzle"]
    docs, labels, where = [], [], {}
    for i in range(700):
        words = draw.choices(clean, k=draw.randrange(20, 120))
        toxic = i % 3 == 0
        for _ in range(draw.randrange(3, 7) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        text = draw.choice([" ", ", "]).join(words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
        raw = text.encode()
        where[i] = sorted((m.start(), m.end()) for b in bad for m in re.finditer(re.escape(b.encode()), raw))
    return docs, labels, where


def test_planted_words_are_found_where_they_stand(spark, planted):
    docs, labels, where = planted
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    # Labels of the held-out fold are turned: they must have no part in the fit.
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    model = toxicity.fit(frame, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    asked = sorted(held)
    assert len(asked) > 100
    right = [(rows[i].score >= 0.5) == bool(labels[i][2]) for i in asked]
    exact = [sorted((s.start, s.stop) for s in rows[i].spans) == where[i] for i in asked]
    assert sum(right) >= 0.98 * len(asked) and sum(exact) >= 0.95 * len(asked)
    assert all(rows[i].n_toxic == len(rows[i].spans) for i in asked)
