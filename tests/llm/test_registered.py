"""The registered corpus queries on whole small tables, each against SQL or brute force."""

import base64
import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import contaminated, plain_print, repeated

from tessera.llm import toxicity
from tessera.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = QUERIES[name](spark, SMALL)
    con.execute(ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, con.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*names).collect())


def test_every_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]


def test_repeats_by_words_and_bytes(spark, texts):
    words, chars = repeated(texts, True, 50), repeated(texts, False, 100)
    for r in QUERIES["op1_substring_dedup"](spark, SMALL).collect():
        n, gone, _, kept = words[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha(kept))
    for r in QUERIES["op4_suffix_dedup"](spark, SMALL).collect():
        n, gone, runs, kept = chars[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, sha(kept))


def test_token_digests(spark, texts):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, SMALL).collect()}
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_fingerprints_and_components(spark, texts):
    prints = {i: plain_print(t, 3) for i, t in texts}
    group = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def test_scores_of_all_documents(spark, texts):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    want = toxicity._scored(toxicity.fit(docs, labels), toxicity.lowered([t for _, t in texts]))[2]
    rows = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, SMALL).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    for (i, _), score in zip(texts, want.tolist(), strict=True):
        r = rows[i]
        assert abs(r.score - score) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    right = [rows[i].predicted == t for i, t in toxic.items() if rows[i].held_out]
    assert sum(right) >= 0.9 * len(right)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.folded(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    sample = [r.text for r in docs.limit(20).collect()]
    a, b = (toxicity._scored(toxicity.fit(docs, x), toxicity.lowered(sample))[2].tolist() for x in (labels, turned))
    assert a == b


def test_contamination_of_all_documents(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = contaminated(texts, items)
    for r in QUERIES["op10_decontaminate"](spark, SMALL).collect():
        n, hit, names, bad = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), sha(",".join(names).encode()), bad)
