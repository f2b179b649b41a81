"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashes."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import aligned, bpe, decontam, fm_index, graph, main_text, passages, run_index, simhash, topk, toxicity, url_templates, warc
from tessera.llm import common as C

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = "h long, place long, node long, kept string, fp long, spans string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def documents(spark, texts, clashes=True):
    rows = [(i, t, *((1, 2, 3, "k", 4, "s") if clashes else ())) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string{', ' + CLASHES if clashes else ''}").repartition(3)


def sentences(seed, n=60):
    pick = random.Random(seed)
    words = ["a", "b", "é", "dd", "Ab", "x,y", "z9"]
    lines = [" ".join(pick.choice(words) for _ in range(pick.randint(2, 14))) for _ in range(10)]
    texts = [" \t".join(pick.choice(lines) for _ in range(pick.randint(0, 8))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, texts[3]), (n + 4, " ".join(lines) * 30)]


def test_task_counts():
    assert [C.tasks(n, 10) for n in (0, 1, 10, 11, 200_000, 2_000_000, 10 ** 9)] == [1, 1, 1, 2, 20_000, 20_000, 3_125_000]


# ---------------------------------------------------------------- repeated passages

def repeated(docs, words, size):
    """Direct model: spans of units whose window starts earlier."""
    seen, out = {}, {}
    for i, t in sorted(docs):
        units = [w.encode() for w in SPACED.findall(t or "")] if words else (t or "").encode()
        gone = bytearray(len(units))
        for a in range(len(units) - size + 1):
            first = seen.setdefault(b" ".join(units[a:a + size]) if words else units[a:a + size], (i, a))
            if first[0] < i if words else first < (i, a):
                gone[a:a + size] = b"\1" * size
        left = [u for u, g in zip(units, gone, strict=True) if not g]
        out[i] = len(units), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), b" ".join(left) if words else bytes(left)
    return out


@pytest.mark.parametrize(("words", "tight"), list(itertools.product((True, False), (False, True))))
def test_repeats(spark, monkeypatch, words, tight):
    """tight: many shards and indexes, and anchors with more passages than one may hold."""
    if tight:
        for name, value in (("SHARD_BYTES", 3000), ("INDEX_BYTES", 500), ("ANCHOR_UNITS", 40), ("CHUNK", 64)):
            monkeypatch.setattr(passages, name, value)
    docs = sentences(1 + words)
    module, size, gram = (fm_index, 6, 3) if words else (run_index, 12, 5)
    found = module.dedup(documents(spark, [*docs, (None, docs[0][1]), docs[5]]), size, gram)
    rows = found.collect()
    assert len(rows) == len(docs) + 2 and {"h", "place", "node", "fp", "spans"} <= set(found.columns)
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.kept.encode() if words else bytes(r.kept)) for r in rows if r.doc_id is not None}
    assert got == repeated(docs, words, size)
    assert next(r.n_removed for r in rows if r.doc_id is None) == 0
    assert module.dedup(documents(spark, []), size, gram).count() == 0


def test_rows_with_one_id_and_other_texts(spark):
    a, b = "p q r s t u v", "x y z p q r s t"
    docs = documents(spark, [(1, a), (2, b), (2, a)])
    got = sorted((r.doc_id, r.n_units, r.n_removed) for r in fm_index.dedup(docs, 4, 2).collect())
    assert got == [(1, 7, 0), (2, 7, 7), (2, 8, 5)]


@pytest.mark.parametrize(("words", "size", "gram"), [(True, 200, 16), (False, 300, 32), (False, 5, 5)])
def test_repeats_of_other_sizes(spark, words, size, gram):
    pick = random.Random(size)
    letters = [f"w{k}" if words else chr(97 + k % 26) for k in range(40)]
    joint = " " if words else ""
    base = [pick.choice(letters) for _ in range(900)]
    texts = [joint.join(base), joint.join(base[150:650]), joint.join(base[:430] + ["zz"] + base[430:]), joint.join(base[300:] + base[:300]), joint.join(base * 2)]
    module = fm_index if words else run_index
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans) for r in module.dedup(documents(spark, [*enumerate(texts)]), size, gram).collect()}
    assert got == {i: v[:3] for i, v in repeated([*enumerate(texts)], words, size).items()}


@pytest.mark.parametrize("words", [True, False])
def test_nothing_is_removed_without_the_index(spark, words):
    """Equal passages and copies are decided by what the index answers, too."""
    class Silent(fm_index.FMColumn if words else run_index.RunColumn):
        def least(self):
            return super().least() * 0 - 1

    of = fm_index.units(6, 3) if words else run_index.units(12, 5)
    docs = documents(spark, sentences(1))
    assert passages.spans(docs, of, Silent).count() == 0 < passages.spans(docs, of, Silent.__base__).count()


def test_columns_that_clash_in_case(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "x", 5, "y")], "doc_id long, text string, KEPT string, N_Removed int, `odd, name` string")
    assert fm_index.dedup(rows, 3, 2).columns == ["doc_id", "text", "odd, name", "kept", "n_units", "n_removed", "n_spans"]
    assert [tuple(r) for r in run_index.dedup(rows, 3, 2).collect()] == [(1, "a b c d e", "y", bytearray(b"a b c d e"), 9, 0, 0)]


@pytest.mark.parametrize("words", [True, False])
def test_earliest_places(words):
    """Windows of aligned passages against direct comparison; ranks with ties."""
    pick = random.Random(3)
    for _ in range(60):
        size, gram = pick.choice([(6, 3), (5, 5), (8, 2)])
        rows = []
        for g in range(pick.randint(1, 4)):
            anchor = [pick.choice("ab") for _ in range(gram)]
            for _ in range(pick.randint(1, 6)):
                n = pick.randint(1, size - gram + 1)
                at = pick.randint(n - 1, size - gram)
                s = [pick.choice("ab") for _ in range(n - 1 + size)]
                s[at:at + gram] = anchor
                rows.append((g, "".join(s), at, n, pick.randint(0, 9)))
        group, texts, at, n, rank = zip(*rows, strict=True)
        strings = pa.array([(" ".join(t) if words else t).encode() for t in texts], pa.binary())
        found = aligned.earliest(aligned.Passages(strings, words, *map(np.array, (group, at, n))), np.array(rank), size, fm_index.FMColumn if words else run_index.RunColumn)
        for p, (g, t, a, k, _) in enumerate(rows):
            for x in range(k):
                holders = [r for g2, t2, a2, k2, r in rows if g2 == g and 0 <= x + a2 - a < k2 and t2[x + a2 - a:x + a2 - a + size] == t[x:x + size]]
                assert found[x, p] == min(holders)
            assert (found[k:, p] == -1).all()


def test_columns_count_symbols():
    pick = np.random.default_rng(5)
    ids = np.concatenate([np.arange(7), np.repeat(pick.integers(0, 7, 40), pick.integers(1, 9, 40))])
    bounds, ranks = np.array([0, 5, 60]), pick.integers(0, 99, len(ids))
    runs, tree = run_index.RunColumn(ids, 7, bounds, ranks), fm_index.FMColumn(ids, 7, bounds, ranks)
    asked, ends = pick.integers(0, 7, 300), pick.integers(0, len(ids) + 1, 300)
    want = [int((ids[:e] == a).sum()) for a, e in zip(asked, ends, strict=True)]
    assert runs.count(asked, ends).tolist() == want == tree.count(asked, ends).tolist()
    assert runs.least().tolist() == tree.least().tolist() == [ranks[:5].min(), ranks[5:60].min(), ranks[60:].min()]
    assert len(runs.keys) < len(ids)


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return "file://" + path, table, tokenizers.PATTERN


def test_tokens_round_trip(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    path, table, pattern = ranks
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    pick = random.Random(2)
    texts = ["", None, "a" * 5000, "the'll 're\x1c\x85  x\n\n y", "<|endoftext|>", "日本語 ٣٤ é́"]
    texts += ["".join(pick.choice(pick.choice(["ab", "the in er on", "ñö'sre\n\t ", "\x1c　 a1٣ "])) for _ in range(pick.randint(0, 200))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, path, pattern), path).collect()
    assert len(rows) == len(texts) and rows == bpe.encode(docs, path, pattern, decoded="decoded").collect()
    for r in rows:
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(docs.where("false"), path, pattern).count() == 0


@pytest.mark.parametrize("together", [1, 64])
def test_merge_order_may_go_down(monkeypatch, together):
    """A merge can make a pair of a lower rank than its own; then a bucket is not merged at once."""
    monkeypatch.setattr(bpe, "TOGETHER", together)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"abcab"]
    whole, got = bpe.Encoder(bpe.Vocabulary(tokens), ".+").merged([b"abc", b"abcabcab"])
    assert np.frombuffer(whole, np.int32).tolist() == [256]
    parts, table = [b"%c" % c for c in b"abcabcab"], {t: r for r, t in enumerate(tokens)}
    while True:
        best = min(((table[x + y], i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if x + y in table), default=None)
        if best is None:
            break
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert np.frombuffer(got, np.int32).tolist() == [table[p] for p in parts]


def test_both_splitters_agree(ranks):
    """Texts with characters beyond the basic plane are split by the other library."""
    pick = random.Random(5)
    plane = [chr(c) for c in bpe._PLANE]
    pick.shuffle(plane)
    split = bpe.splitter(ranks[2])
    texts = ["".join(plane), " ".join(plane), "".join(x + pick.choice(["a", " ", "1", "\n ", "'s"]) for x in plane)]
    for text in texts:
        assert split(text + " z") == split(text + " z \U0001F600")[:-1]
    assert bpe._within_plane(r"\w+") is None and bpe._within_plane(r"\p{L}+|[^\t\p{N}]") is not None


@pytest.mark.parametrize("together", [1, 8, 64, 1 << 30])
def test_any_vocabulary_merges_in_order(monkeypatch, together):
    """Random tokens, also such as merge into lower ranks, against merging the least and leftmost pair."""
    monkeypatch.setattr(bpe, "TOGETHER", together)
    pick = random.Random(together)
    for _ in range(30):
        more = {bytes(pick.choice(b"abc") for _ in range(pick.randint(2, 5))) for _ in range(25)}
        tokens = [bytes([b]) for b in range(256)] + sorted(more, key=lambda t: pick.random())
        table = {t: r for r, t in enumerate(tokens)}
        pieces = [bytes(pick.choice(b"abc") for _ in range(pick.randint(1, 30))) for _ in range(40)]
        for piece, got in zip(pieces, bpe.Encoder(bpe.Vocabulary(tokens), ".+").merged(pieces), strict=True):
            parts = [bytes([c]) for c in piece]
            while piece not in table:
                best = min(((table[x + y], i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if x + y in table), default=None)
                if best is None:
                    break
                parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert np.frombuffer(got, np.int32).tolist() == ([table[piece]] if piece in table else [table[p] for p in parts])


@pytest.mark.parametrize("together", [1, 64])
def test_long_pre_tokens_and_unknown_ids(ranks, monkeypatch, together):
    tiktoken = pytest.importorskip("tiktoken")
    path, table, pattern = ranks
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    tokens = [None] * (max(table.values()) + 1)
    for t, r in table.items():
        tokens[r] = t
    vocabulary = bpe.Vocabulary(tokens)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    monkeypatch.setattr(bpe, "TOGETHER", together)
    pick = random.Random(4)
    texts = ["".join(pick.choice("aethin") for _ in range(pick.choice([3, 9, 4000]))) for _ in range(60)] * 2
    encoder = bpe.Encoder(vocabulary, pattern)
    for a in range(0, len(texts), 20):
        ids, counts = encoder.encode(texts[a:a + 20])
        assert np.split(ids, np.cumsum(counts)[:-1])[3].tolist() == own.encode_ordinary(texts[a + 3])
        assert ids.tolist() == [i for t in texts[a:a + 20] for i in own.encode_ordinary(t)]
        assert [x.decode() for x in vocabulary.decode(ids, counts).to_pylist()] == texts[a:a + 20]
    for odd in ("\x01", "a", "\x01\x02", "x\x01"):  # pieces without any pair
        assert bpe.Encoder(vocabulary, pattern).encode([odd, "", None])[0].tolist() == own.encode_ordinary(odd)
    for wrong in (-1, len(tokens)):
        with pytest.raises(ValueError, match="no token has the id"):
            vocabulary.decode(np.array([5, wrong]), np.array([2]))
    with pytest.raises(ValueError, match="no token spells"):
        bpe.Vocabulary([b"a"])


# ---------------------------------------------------------------- near duplicates

def plain_print(text, size):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("bits", "bucket"), [(3, 4096), (3, 6), (7, 4096), (7, 20)])
def test_simhash_groups(spark, monkeypatch, bits, bucket):
    pick = random.Random(bits)
    base = [pick.getrandbits(64) for _ in range(6)]
    fps = {0} | {b ^ sum(1 << k for k in pick.sample(range(64), pick.randint(0, 6))) for b in base for _ in range(25)}
    classes = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in fps], "fp long, node long")
    roots = {r.node & (2 ** 64 - 1): r.root for r in graph.components(simhash.links(classes, bits, bucket)).collect()}
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= bits:
            group[find(a)] = find(b)
    for a, b in itertools.combinations(sorted(fps), 2):
        same = roots.get(a, simhash.signed(a)) == roots.get(b, simhash.signed(b))
        assert same == (find(a) == find(b))


def rows_made(spark, does):
    """Rows that Generate and MapInArrow nodes made while ``does`` ran, by node, and the texts of the nodes."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsList().last().executionId()  # the list keeps the latest only
    does()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made, texts = Counter(), set()
    for k in range(before + 1, store.executionsList().last().executionId() + 1):
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name() in ("Generate", "MapInArrow") and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made[node.name()] += int(values.apply(metric.accumulatorId()).replace(",", ""))
                    texts.add((node.name(), re.sub(r"#\d+L?", "", node.desc())))
    return made, texts


def test_rows_made_for_plan_and_buckets(spark):
    def classes(n, seed):
        pick = random.Random(seed)
        return C.written(spark.createDataFrame([(simhash.signed(pick.getrandbits(64)), k, k % 3) for k in range(n)], "fp long, node long, band long").repartition(4), "classes")

    few, many = classes(10_000, 1), classes(40_000, 2)
    # Planned with values summed up in each task: four times the classes do not make four times the rows.
    made = [sum(rows_made(spark, lambda c=c: simhash.plan(c, 12, F.col("band")))[0].values()) for c in (few, many)]
    assert made[1] < 2 * made[0] and made[1] < 6 * 40_000
    # A class makes a row per partition to count buckets, and one per probe to be compared: no more; both read alike for any masks.
    runs = [rows_made(spark, lambda c=c: simhash.links(c, 12, banded=True)) for c in (few, classes(10_000, 3))]
    assert [made["Generate"] for made, _ in runs] == [(13 + 26) * 10_000] * 2
    assert len({tuple(sorted(t for t in texts if t[0] == "Generate")) for _, texts in runs}) == 1


def test_pairs_by_mask(spark, monkeypatch):
    pick = random.Random(29)
    rows = [(simhash.signed(pick.getrandbits(64) & 0xF00000000000000F), k % 3) for k in range(500)]
    masks = [simhash.signed(m) for m in (0, 0xF, 0xF << 60, 0xF00000000000000F, 0x7)]
    for held in (7, 1 << 17):
        monkeypatch.setattr(simhash, "HELD_ROWS", held)
        got = simhash.pairs_by_mask(spark.createDataFrame(rows, "fp long, band int").repartition(3), masks, F.col("band"))
        assert got == {m: sum(n * n for n in Counter((fp & m, band) for fp, band in rows).values()) for m in masks}
    assert simhash.pairs_by_mask(spark.createDataFrame([], "fp long"), masks, F.lit(0)) == {}


def test_fingerprints_and_components(spark):
    texts = [*sentences(4, 25), (100, "One two"), (101, "one  TWO"), (None, "lone words here now"), (102, "")]
    rows = simhash.near_groups(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fp & (2 ** 64 - 1))
    assert all(prints[i] == {plain_print(t, 3)} for i, t in texts)
    by_id = {r.doc_id: r.component_id for r in rows}
    empty = min(i for i, t in texts if i is not None and not SPACED.findall(t or ""))
    assert by_id[101] == 100 and by_id[102] == by_id[25] == empty and by_id[None] is None
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_keep_one(spark):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [pick.choice(words) for _ in range(200)]
    near = [*base]
    near[100] = "other"
    texts = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (1, " ".join(pick.choice(words) for _ in range(200))), (11, None), (12, ""), (13, "few words"), (None, " ".join(base)), (None, "only here")]
    kept = simhash.keep_one(documents(spark, texts).withColumn("NEAR_ID", F.lit(1)).withColumn("near_node", F.lit(2))).drop("near_id", "near_node")
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 3, 11, 13]
    assert kept.columns == documents(spark, []).columns and simhash.keep_one(documents(spark, [])).count() == 0


def kept_by_brute_force(texts, size=5, bits=12, similarity=0.8):
    hashes = [simhash.shingle_hashes(t.encode(), size) for _, t in texts]
    prints = [[simhash.majority(C.mix(h + np.uint64(k)) if k else h) for k in range(2)] for h in hashes]
    sets = [set(h.tolist()) for h in hashes]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        apart = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
        if min(apart) <= bits and sum(apart) <= simhash.JOINT and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, _), g in zip(texts, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return sorted(least.values())


def edited(words, pick, n):
    out = [*words]
    for k in pick.sample(range(len(words)), n):
        out[k] = f"e{pick.getrandbits(40)}"
    return out


@pytest.mark.parametrize("bucket", [4096, 6])
def test_all_links_between_labels(spark, bucket):
    pick = random.Random(2)
    base = [pick.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << k for k in pick.sample(range(64), pick.randint(0, 3))) for b in base for _ in range(20)})
    rows = [(simhash.signed(f), simhash.signed(f), k % 3) for k, f in enumerate(fps)]
    found = simhash.links(spark.createDataFrame(rows, "fp long, node long, label long"), 3, bucket, compare=simhash._crossing).distinct().collect()
    want = {(min(a, b), max(a, b)) for (a, _, x), (b, _, y) in itertools.combinations(rows, 2) if x != y and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    assert {(r.u, r.v) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("labels", [1, 2, 30])
def test_a_hot_fingerprint_stays_in_its_bucket(spark, monkeypatch, labels):
    """No bits part rows of one fingerprint: they are not copied into ever more buckets, and all their pairs of different labels are found."""
    pick, dealt = random.Random(5), []
    keep = C.written
    monkeypatch.setattr(C, "written", lambda df, name: (out := keep(df, name), dealt.append(out.count()) if name == "buckets" else None)[0])
    hot = pick.getrandbits(64)
    fps = [hot] * 200 + [hot ^ (1 << k) for k in range(6)]
    rows = [(simhash.signed(f), k, k % labels, 0) for k, f in enumerate(fps)]
    given = spark.createDataFrame(rows, "fp long, node long, label long, band long")
    found = simhash.links(given, 12, 8, banded=True, compare=simhash._crossing).distinct().collect()
    assert {(r.u, r.v) for r in found} == {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if a % labels != b % labels}
    assert not dealt  # seven different fingerprints fit a bucket of eight


def test_the_most_common_label_of_a_bucket():
    key, label = np.array([2, 1, 1, 1, 2, 2, 3]), np.array([9, 5, 6, 6, 8, 9, 1])
    assert simhash._most_common(key, label).tolist() == [True, False, True, True, False, True, True]
    assert simhash._most_common(key[:0], label[:0]).tolist() == []


def test_keep_one_tests_all_candidate_pairs(spark):
    pick = random.Random(5)
    base = [f"w{pick.getrandbits(40)}" for _ in range(300)]
    star = [base, *(edited(base, pick, 5) for _ in range(60))]
    chain = [[f"c{pick.getrandbits(40)}" for _ in range(200)]]
    for _ in range(20):
        chain.append(edited(chain[-1], pick, 4))
    # Equal fingerprints: the passage of one word decides all bits.
    tail = ["same"] * 200 + [f"t{k}" for k in range(30)]
    alike = [tail, *([*tail, *(f"a{pick.getrandbits(40)}" for _ in range(5))] for _ in range(10))]
    assert len({simhash.fingerprint(" ".join(t).encode(), 5) for t in alike}) == 1
    texts = [" ".join(t) for t in star + chain + alike]
    pick.shuffle(texts)
    texts = [*enumerate(texts)]
    kept = [r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()]
    assert sorted(kept) == kept_by_brute_force(texts)


def test_keep_one_finds_nearly_all_pairs(spark):
    """Against all pairs by Jaccard similarity alone, of the given table and of edited copies near the threshold."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    pick = random.Random(11)
    for k in range(60):
        base = [f"w{pick.getrandbits(40)}" for _ in range(400)]
        rows += [(100000 + 2 * k, " ".join(base)), (100001 + 2 * k, " ".join(edited(base, pick, 3 + k % 6)))]
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)).tolist() for _, t in rows]
    holders = {}
    for k, own in enumerate(sets):
        for h in own:
            holders.setdefault(h, []).append(k)
    both = Counter(p for ks in holders.values() if len(ks) < 200 for p in itertools.combinations(ks, 2))
    pairs = {p for p, n in both.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) and rows[p[0]][1] != rows[p[1]][1]}
    read = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.xxhash64("text"))
    nodes = simhash._sizes_and_prints(read, 5, 0.8).drop("doc_id").distinct()
    node = {r.doc_id: r.node for r in read.select("doc_id", "node").collect()}
    found = set()
    for fp in simhash.PRINTS:
        search = simhash._Candidates(nodes, fp, 12, 0.8)
        none = spark.createDataFrame([], "node long, root long")
        found |= {tuple(sorted((r.u, r.v))) for r in search.first().unionByName(search.apart(none, simhash._crossing)).collect()}
    want = {tuple(sorted((node[rows[a][0]], node[rows[b][0]]))) for a, b in pairs}
    assert len(want) >= 60 and len(want & found) >= 0.95 * len(want)


def test_outlines_bound_the_similarity():
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 5, 150, 150, 900, 3000)]
    sets += [np.unique(np.concatenate((s[:len(s) * 9 // 10], pick.integers(0, 1 << 63, len(s) // 10 + 1, dtype=np.uint64)))) for s in sets]
    table = pa.table({"outline": pa.array([simhash.outline(s) for s in sets], pa.binary()), "size": [len(s) for s in sets]})
    order = pick.permutation(len(sets))
    outlines = simhash.Outlines(table, order)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    most = outlines.most(a, b)
    for x, y, m in zip(a.tolist(), b.tolist(), most.tolist(), strict=True):
        s, t = set(sets[order[x]].tolist()), set(sets[order[y]].tolist())
        assert m >= (len(s & t) / len(s | t) if s | t else 1.0) - 1e-12
    assert most[(a != b)].min() < 0.3  # and says something


def test_forest_spans_what_all_pairs_join():
    pick = random.Random(6)
    base = [pick.getrandbits(64) for _ in range(4)]
    rows = [(pick.randrange(2), pick.random() < 0.7, base[k % 4] ^ sum(1 << b for b in pick.sample(range(64), 3)), k, k // 3) for k in range(60)]
    whole = pa.table({"bucket": [r[0] for r in rows], "home": [r[1] for r in rows], "fp": pa.array([r[2] for r in rows], pa.uint64()).view(pa.int64()), "node": [r[3] for r in rows], "label": [r[4] for r in rows]})
    every, tree = simhash._crossing(whole, 6), simhash._forest(whole, 6)
    assert 0 < len(tree) < len(every)

    def roots(t):
        return graph.local_roots(20, t["u"].to_numpy() // 3, t["v"].to_numpy() // 3).tolist()

    assert roots(every) == roots(tree)


def test_streamed_buckets_give_all_pairs(monkeypatch):
    """Any cut into batches and pieces finds what one piece finds."""
    pick = random.Random(3)
    rows = sorted(((pick.randrange(3), pick.random() < 0.6, pick.getrandbits(3), k) for k in range(80)), key=lambda r: (r[0], not r[1]))
    whole = pa.table({"bucket": [r[0] for r in rows], "fp": [r[2] for r in rows], "node": [r[3] for r in rows], "home": [r[1] for r in rows], "label": [r[3] for r in rows]})
    pairs = lambda t: set(zip(t["u"].to_pylist(), t["v"].to_pylist(), strict=True))
    want = pairs(simhash._crossing(whole, 1))
    for held, size in ((1000, 7), (10, 4), (3, 80)):
        monkeypatch.setattr(simhash, "HELD_ROWS", held)
        got = set().union(*(pairs(pa.Table.from_batches([b])) for b in simhash._streamed(whole.to_batches(max_chunksize=size), 1, simhash._crossing)))
        assert got == want


def test_keep_one_of_texts_that_repeat(spark):
    pick = random.Random(7)
    base = [f"w{pick.getrandbits(40)}" for _ in range(300)]
    texts = [*enumerate(" ".join(t) for t in (base, base * 2, edited(base, pick, 60)))]
    assert len({simhash.fingerprint(t.encode(), 5) for _, t in texts}) == 3  # equal ones are verified in any band
    assert kept_by_brute_force(texts) == [0, 2]
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()) == [0, 2]


def test_allocation_of_thresholds():
    costs = [[1, 5, 50, 500], [10, 11, 12, 13], [100, 400, 900, 1600]]
    best = min((sum(c[t] for c, t in zip(costs, ts, strict=True) if t >= 0), ts) for ts in itertools.product(range(-1, 4), repeat=3) if sum(t + 1 for t in ts) == 4)
    got = simhash.allocate(costs, 4)
    assert sum(t + 1 for t in got) == 4 and sum(c[t] for c, t in zip(costs, got, strict=True) if t >= 0) == best[0]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in graph.components(links).collect()} == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# ---------------------------------------------------------------- search, urls

def test_top_k(spark):
    pick = np.random.default_rng(3)
    rows = [(i, [float(x) for x in pick.normal(size=5)]) for i in range(300)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (404, [0.5, 0.5]), (405, [0.0] * 5), (500, []), (None, [1.0] * 5)]
    rows += [(600 + i, [1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(30)]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = {}
    for r in topk.search(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in ints if i % 100 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.search(vectors.where("false"), vectors.where("false")).count() == 0


def test_top_k_stops_early():
    """With few dimensions, or a few that decide, most rows are never scored; results are those of all rows."""
    pick = np.random.default_rng(7)
    for width, spread, most in ((3, np.ones(3), 0.6), (40, np.r_[np.full(3, 1.0), np.full(37, 0.002)], 0.7)):
        rows = np.floor(1024 * pick.normal(size=(20000, width)) * spread).astype(np.int64)
        ids, asked = np.arange(20000), rows[::1000] * 1
        best = topk.Best(asked, ids[::1000], 10)
        for start in range(0, 20000, topk.BLOCK):
            best.block(ids[start:start + topk.BLOCK], rows[start:start + topk.BLOCK])
        assert best.scored < most * len(asked) * len(rows)
        for q, (scores, found) in enumerate(best.kept):
            every = rows @ asked[q]
            every[q * 1000] = -(1 << 62)
            order = np.lexsort((ids, -every))[:10]
            assert found.tolist() == order.tolist() and scores.tolist() == every[order].tolist()


def test_too_many_ranks_are_refused():
    with pytest.raises(ValueError, match="ranks"):
        bpe.Vocabulary([bytes([b]) for b in range(256)] + [None] * (1 << 20))


def test_url_rules_and_templates(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM?x", "https://x.net/a", "https://net/", "https://net", "https://www.example.net/en/1?q#f", "https://example.net/de/1", "x://example.com/de/", "x://a.org/fr/#", "x://notexample.com/de/", "a://b://c/d"]
    rows = [(i, u, 1, "s") for i, u in enumerate(urls)] + [(100 + i, f"http://shop.example.com/de/{i}", 1, "s") for i in range(30)] + [(200 + i, f"http://shop.example.com/x/{i}", 1, "s") for i in range(5)] + [(200, "http://shop.example.com/x/0", 1, "s")]
    found = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string, segments long, kept string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert found.count() == len(rows) and "segments" in found.columns
    want = [("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "", None), ("x.net", "/a", "net/"), ("net", "/", "net/"), ("net", "", None), ("www.example.net", "/en/1", "example.net/en/"), ("example.net", "/de/1", "net/"),
            ("example.com", "/de/", "example.com/de/"), ("a.org", "/fr/", "org/fr/"), ("notexample.com", "/de/", None), ("b:", "//c/d", None)]
    assert [got[i][:3] for i in range(len(urls))] == want
    assert got[5][3] == "block" and got[8][3] == "allow" and got[0][3] == "allow"
    assert got[203][2:] == (None, "block")  # the host's other templates are all blocked
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    none = url_templates.judge(spark.createDataFrame([], "page_id long, url string, HOST int"))
    assert none.count() == 0 and none.columns == ["page_id", "url", "host", "path", "template", "rule", "verdict"]


def test_url_tree(spark):
    """Branches are told apart by their parents, merged where alike, with all that is below them."""
    urls = [f"http://h.com/{a}/{b}/{k}" for a in ("one", "two") for b in ("x", "y") for k in range(10)] + [f"http://h.com/p{k}/x" for k in range(5)] + ["http://h.com/one/x/0/" + "d/" * 10, "http://h.com/"]
    rules = (("block", "h.com", "/one/x/"), ("allow", "h.com", "/one/y/"))
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = {r.url: (r.template, r.verdict) for r in url_templates.judge(pages, rules).collect()}
    # one and two: two has no labels, so it is merged with one; x and y differ in their labels.
    assert got["http://h.com/one/x/3"] == ("/#/x/?", "block") == got["http://h.com/two/x/4"]
    assert got["http://h.com/one/y/3"] == ("/#/y/?", "allow") == got["http://h.com/two/y/4"]
    assert got["http://h.com/p3/x"][0] == "/?/x" and got["http://h.com/"] == ("/", "allow")
    assert got[urls[-2]][0] == "/#/x/?" + "/d" * 10  # as deep as the path


# ---------------------------------------------------------------- pages

def test_everything_within_a_filled_region_stays():
    """Headings, items and cells of an article, whatever their own score; not its parts set apart, its link lists or what is beside it."""
    para = "<p>A sentence of the text, with marks; and another one. It goes on.</p>"
    plain = "A sentence of the text, with marks; and another one. It goes on."
    menu = "<section><ul><li><a href='/a'>first link</a><li><a href='/b'>second link</a></ul></section>"
    table = "<table><tr><td>left cell<td>12</table>"
    page = f"<body><nav>n</nav>{menu}<article><h1>Top</h1>{para * 2}<h2>Low</h2>{para * 3}<ul><li>one<li>two</ul>{table}<aside>ad</aside><div><a href='/'>more</a> <a href='/'>links</a></div></article><footer>f</footer></body>"
    want = " ".join(["Top", plain, plain, "Low", plain, plain, plain, "one two left cell 12"])
    assert main_text.main_text(page) == want
    assert main_text.main_text(page.replace("article", "div")) == want
    short = f"<body>{menu}<main><h1>Top</h1>{para}<h2>Low</h2><ol><li>one<li>two</ol></main></body>"
    assert main_text.main_text(short) == f"Top {plain} Low one two"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<script>var t='<p>x</p>'</script><p>a &amp;\n b<br>c", "a & b c"), ("<!-- <p>no</p> --><p>one, two. Three.</p>", "one, two. Three."),
    ("<nav><a>x</a></nav><div class='side-bar ad'>buy</div><article><h1>T</h1><p><b>first, bold.<br><p>Second. &copy;</p><form>in</form></article><footer>f</footer>", "T first, bold. Second. ©"),
    ("<body><div class='wrap'><h1>Head</h1><p>Text, with marks. More text here.</p></div><div id='comments'><article class='comment'><p>No, I say. Never.</p></article></div></body>", "Head Text, with marks. More text here."),
    ("<p title='a>b' hidden>gone</p><p>stays, yes.</p>", "stays, yes.")])
def test_main_text(page, text):
    assert main_text.main_text(page) == text


LONG = "A sentence of some length, with marks; and another part of it. "


@pytest.mark.parametrize(("page", "text"), [
    # Sibling articles, linked sentences, short paragraphs and unmarked headings stay.
    (f"<body><nav><a href=x>One</a> <a>Two</a></nav><article><p>{LONG * 4}</p><p><a href=y>{LONG}</a></p><p>Yes.</p></article><article><p>{LONG * 2}</p></article></body>", (LONG * 4 + LONG + "Yes. " + LONG * 2).strip()),
    (f"<div class=top-menu><ul><li><a>Home</a><li><a>News</a></ul></div><div class=c><h2>Title here</h2><p>{LONG * 3}<p>Short.</div><div class='sidebar'><p>{LONG}</p></div><footer><p>{LONG}</p></footer>", ("Title here " + LONG * 3 + "Short.").strip()),
    # Readers' comments, notices and links are no article, however long.
    (f"<main><h1>T</h1><p>{LONG * 2}</p></main><section id=comments><p>{LONG * 9}</p></section><div class=cookie-notice><p>{LONG * 5}</p></div><div><p>{LONG}</p></div>", ("T " + LONG * 2).strip()),
    (f"<body><ul><li><a>{LONG}</a></li><li><a>{LONG}</a></li></ul></body>", "")])
def test_main_text_by_path_scores(page, text):
    assert main_text.main_text(page) == text


def test_main_text_takes_and_leaves_whole_paths(monkeypatch):
    page = f"<nav><p>One two.</p></nav><article><h1>T</h1><p>{LONG}</p><p>No</p></article><footer>F, f.</footer>"
    found = main_text.blocks(page)
    score, threshold = main_text.scores(found)
    assert {p for p, s in score.items() if s >= threshold} == {"/article*/h1", "/article*/p"}
    monkeypatch.setattr(main_text, "THRESHOLD", 0.0)
    assert main_text.main_text(page) == f"One two. T {LONG}No F, f."


def test_main_text_of_planted_articles(spark):
    """Pages of the given table mark their articles: a plain parser reads them."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.parts.append(" ")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.parts += " " * (tag != "b")

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    exact = 0
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        want, have = "".join(parser.parts).split(), got[r.page_id].split()
        both = sum((Counter(want) & Counter(have)).values())
        assert 2 * both >= 0.99 * (len(want) + len(have))
        exact += want == have
    assert exact >= 0.99 * len(got)


def test_main_text_of_a_table(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>Some, text.</p></article>", "x"), (None, None, None, None), (1, "u", "<p>" + "word, " * 50000, "x")], "page_id long, url string, html string, text string")
    got = main_text.extract(rows).collect()
    assert len(got) == 3 and {len(r.text) for r in got} == {11, 0, 299999}


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_warc_round_trip(spark, chunk):
    inside = "x" * 10 + "\r\n\r\nWARC/1.1\r\n0\r\n" + "é\r" * 30
    rows = [(1, "http://a", inside, 5), (2, None, None, 5), (3, "u\r\nX: y", "", 5), (None, "q", inside, 5), (4, "z", "ab\r\n" * 20, 1), (4, "z", "ab\r\n" * 20, 1), (9, "z", "ab\r\n" * 20, 1), (11, "z", "0123456", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, data int").coalesce(2)
    path = C.fresh_path(spark, "test")
    warc.write_archives(pages, path, chunk=chunk)
    back = warc.read_archives(spark, path).collect()
    last = [r for r in back if r.last]
    assert sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in last) == [(0, "revisit", 1, len(inside.encode())), (1, "response", None, len(inside.encode())), (2, "response", None, 0), (3, "revisit", 2, 0), (4, "response", None, 80), (4, "response", None, 80), (9, "revisit", 4, 80), (11, "response", None, 7)]
    payload = b"".join(bytes(r.data) for r in sorted((r for r in back if r.page_id == 1), key=lambda r: r.chunk_no))
    digest = base64.b32encode(hashlib.sha1(inside.encode()).digest()).decode()
    assert payload == inside.encode() and {r.payload_digest for r in last if r.page_id in (1, None)} == {digest}
    assert max(len(r.data) for r in back) <= chunk


def test_warc_small_payloads_and_damage(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    path = C.fresh_path(spark, "test")
    warc.write_archives(pages, path, min_bytes=5)
    assert [r.record_type for r in warc.read_archives(spark, path).where("last").collect()] == ["response"] * 2
    reader = warc.Reader(True)
    with pytest.raises(ValueError, match="no record begins"):
        reader.line("f", b"junk")
    empty = C.fresh_path(spark, "test")
    warc.write_archives(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


# ---------------------------------------------------------------- benchmark

def contaminated(docs, items, window=13):
    windows = {}
    for i, t in items:
        words = PLAIN.findall(lower(t))
        size = min(window, len(words))
        for a in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[a:a + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        words, names = PLAIN.findall(lower(t)), set()
        hit = [False] * len(words)
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                if found := windows.get(tuple(words[a:a + size])):
                    names |= found
                    hit[a:a + size] = [True] * size
        out[d] = len(words), sum(hit), sorted(names), any(hit) and 20 * sum(hit) >= len(words)
    return out


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    pick = random.Random(8)
    docs = sentences(8, 40)
    items = [(i, " ".join((docs[pick.randrange(40)][1] or "x").split()[:pick.randint(1, 20)])) for i in range(9)] + [(20, ""), (21, None), (22, "!!"), (23, "b"), (23, "dd dd")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.with_verdict(decontam.find(documents(spark, docs), table)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found} == contaminated(docs, items)
    clean = decontam.clean(documents(spark, docs).withColumn("TAINT_ID", F.lit(1)), table)
    assert {r.doc_id for r in clean.collect()} == {d for d, v in contaminated(docs, items).items() if not v[3]} and "h" in clean.columns
    assert decontam.find(documents(spark, docs), table.where("false")).where("size(items) > 0").count() == 0


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_longest_match(spark, monkeypatch, block):
    """Against direct comparison of all places; several blocks agree with one."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    words = [f"w{i}" for i in range(40)]
    pick = random.Random(4)
    letters = [[pick.choice("abc") for _ in range(pick.randint(0, 60))] for _ in range(12)]
    docs = [(1, words[5:15]), (2, words), (3, words[:4] + ["x"] + words[2:20]), (4, ["none"]), *((10 + k, t) for k, t in enumerate(letters[:6]))]
    items = [("q", words[:30]), *((f"r{k}", t) for k, t in enumerate(letters[6:]))]
    found = decontam.find(documents(spark, [(i, " ".join(t)) for i, t in docs]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id string, text string")).collect()
    got = {r.doc_id: r for r in found}
    assert got[2].longest == 30 and (got[2].longest_at, got[2].longest_item, got[2].longest_item_at) == (0, "q", 0) and got[4].longest == 0
    for i, own in docs:
        most = 0
        for _, other in items:
            for a in range(len(own)):
                for b in range(len(other)):
                    k = 0
                    while a + k < len(own) and b + k < len(other) and own[a + k] == other[b + k]:
                        k += 1
                    most = max(most, k)
        r = got[i]
        assert r.longest == (most if most >= decontam.LEAD else 0) or (most < decontam.LEAD and r.longest == most)
        if r.longest:
            other = dict(items)[r.longest_item]
            assert own[r.longest_at:r.longest_at + r.longest] == other[r.longest_item_at:r.longest_item_at + r.longest]


# ---------------------------------------------------------------- toxicity

def test_toxicity_held_out(spark):
    pick = random.Random(6)
    plain, bad = [f"{pick.choice('bcdfg')}{pick.choice('aeiou')}{pick.choice('lmnrst')}{i}" for i in range(300)], ["vile", "rotten", "foulish"]
    texts, labels = [], []
    for i in range(400):
        words = [pick.choice(plain) for _ in range(pick.randint(20, 90))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else i % 7 == 0):
            words.insert(pick.randrange(len(words)), pick.choice(bad))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    copies = [(1000 + i, texts[0][1]) for i in range(20)]  # copies of a toxic text do not make its words toxic
    table = spark.createDataFrame(labels + [(c[0], 1) for c in copies] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = documents(spark, [*texts, *copies, (2000, None), (2001, ""), (None, "vile rotten vile"), (2002, "lone " * 30000)])
    model = toxicity.fit(docs, table)
    rows = toxicity.score(docs, model).collect()
    held = [(r.score >= 0.5, dict(labels)[r.doc_id]) for r in rows if r.doc_id in dict(labels) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and all(r.score < 0.5 for r in rows if r.doc_id in (2000, 2001, 2002))
    r = next(r for r in rows if r.doc_id == 0)
    found = {texts[0][1].encode()[s.start:s.stop].decode().lower() for s in r.spans}
    assert found <= set(bad) and found
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


def test_marginals_equal_enumeration(monkeypatch):
    """Blocks and groups of any size give the whole chain's marginals."""
    pick = np.random.default_rng(1)
    chain = toxicity.Chain(np.empty(0, np.uint64))
    chain.moves = pick.normal(size=(2, 2)) * 2
    counts = [0, 7, 3, 0, 1, 10, 2]
    first = np.concatenate(([0], np.cumsum(counts)))
    lead = pick.normal(size=first[-1]) * 2
    want, pairs = np.zeros(len(lead)), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, on, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(lead[a + t] * y[t] for t in range(b - a)) + sum(chain.moves[y[t - 1], y[t]] for t in range(1, b - a)))
            total += w
            on += w * np.array(y)
            for t in range(1, b - a):
                joint[y[t - 1], y[t]] += w
        want[a:b] = on / total
        pairs += joint / total
    for block, held in ((64, 4096), (2, 4096), (3, 1), (1, 2)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "HELD", held)
        got, joint = chain.marginals(lead, first)
        assert np.allclose(got, want) and np.allclose(joint, pairs)


def test_a_chain_carries_beyond_its_blocks():
    chain = toxicity.Chain(np.empty(0, np.uint64))
    chain.moves = np.array([[3.0, -3.0], [-3.0, 3.0]])
    lead = np.zeros(200)
    lead[0] = 4.0
    got, _ = chain.marginals(lead, np.array([0, 200]))
    # Of a chain whose words say nothing but the first, P(toxic) nears one half by the power of the moves.
    ahead, move = np.array([1.0, np.exp(4.0)]), np.exp(chain.moves)
    for t in range(1, 120):
        ahead = ahead @ move
        ahead /= ahead.sum()
    assert abs(got[119] - ahead[1]) < 1e-9 and got[119] > 0.55


def test_toxic_offsets_are_those_of_the_text():
    texts = ["\u0130stanbul \u1e9e VILE Rotten", "\u212ael vile", "plain VILE", None]
    for t, low in zip(texts, toxicity.lowered(texts), strict=True):
        raw = (t or "").encode()
        assert len(low) == len(raw)
        at = low.find(b"vile")
        assert at < 0 or raw[at:at + 4].lower() == b"vile"
