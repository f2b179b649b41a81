"""The corpus pipeline as a whole against plain Python, and its stages on tables with nulls, ties and clashes."""

import base64

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity

from test_operators import contaminated, kept_by_brute_force, repeated

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_python(spark):
    import public_tokenizers
    import tiktoken

    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    docs = {r.doc_id: r for r in read("documents").collect()}
    model = toxicity.fit(read("documents"), read("labels"))
    texts = [(i, docs[i].text) for i in sorted(docs)]
    scores = toxicity._scored(model, toxicity.lowered([t for _, t in texts]))[2]
    texts = [x for x, s in zip(texts, scores, strict=True) if s < 0.5]
    keep = set(kept_by_brute_force([(i, t or "") for i, t in texts]))
    texts = [x for x in texts if x[0] in keep]
    cut = repeated(texts, True, 50)
    texts = [(i, cut[i][3].decode() if cut[i][1] else t) for i, t in texts]
    bad = contaminated(texts, [(r.item_id, r.text) for r in read("benchmark").collect()])
    texts = {i: t for i, t in texts if not bad[i][3]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert 0 < len(got) < len(docs) and got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert r.text == t and r.round_trip and (r.lang, r.source) == (docs[i].lang, docs[i].source)
        assert list(r.ids) == own.encode_ordinary(t or "") and r.n_tokens == len(r.ids) and r.n_chars == (len(t) if t is not None else docs[i].n_chars)


def test_stages_on_odd_tables(spark):
    rows = [(1, "a b", "x", "y", 3), (2, None, None, None, None), (3, "", "x", "y", 0), (None, "c d e", "x", "y", 5), (4, "w " * 60, "x", "y", 120), (4, "w " * 60, "x", "y", 120), (5, "v " + "w " * 59, "x", "y", 120)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (rows, []):
        for clash in ((), ("KEPT", "n_Units", "IDS_", "near_id", "taint_key", "own", "row")):
            docs = spark.createDataFrame(table, schema)
            for c in clash:
                docs = docs.withColumn(c, F.lit(7))
            for name, stage in corpus_pipeline.STAGES:
                before, docs = docs, stage(spark, docs, SMALL)
                out = docs.collect()
                assert len(out) <= len(table)
                if name == "bpe_encoding":
                    assert {"ids", "n_tokens", "round_trip"} <= set(docs.columns) and all(r.round_trip for r in out)
                else:
                    assert docs.columns == before.columns
                    assert all(r[c] == 7 for r in out for c in clash)
            if table:
                assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 4, 4, 5] and not [r for r in out if r.doc_id == 2][0].ids
