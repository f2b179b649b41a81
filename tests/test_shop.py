"""Sketches, recursion, variants, bucketed repairs, checksum trees and streams with two clocks, on small cases."""

import datetime
import json
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import differing, gallop, postings, records, shapes, sketches
from tessera.sources import buckets
from tessera.streaming import expiring, late, streams

START = datetime.datetime(2024, 1, 1)


# ---------------------------------------------------------------- sketches

@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """40 000 rows over ten days, one client with half of them; stored, then the last day again."""
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval((F.col("id") % 10).cast("int"))
    client = F.when(F.col("id") % 2 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(20_000)))
    rows = spark.range(40_000).select(at.alias("ts"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("kind"), client.alias("client"), F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 7.0).alias("value"))
    path = str(tmp_path_factory.mktemp("days"))
    sketched = sketches.daily(rows, "ts", ["kind"], "client", "value", "client")
    sketches.stored(sketched.where("day < '2024-01-10'"), path)
    sketches.stored(sketched.where("day >= '2024-01-09'"), path)  # one day replaced, one added
    return rows, spark.read.parquet(path)


def test_rolled_sketches_keep_their_bounds(days):
    rows, stored = days
    assert stored.count() == 10 * 3
    got = {(r.level, r.kind): r for r in sketches.answers(sketches.rolled(stored, ["kind"]), [0.1, 0.5, 0.9], 3).collect()}
    groups = [(0, k, rows.where(F.col("kind").eqNullSafe(k))) for k in (None, "k1", "k2")] + [(1, None, rows)]
    assert set(got) == {(level, k) for level, k, _ in groups}
    for level, k, part in groups:
        r, n = got[level, k], part.count()
        exact = part.select("client").distinct().count()
        assert r.n == n and abs(r.distinct - exact) <= sketches.DISTINCT_ERROR * exact
        values = part.where("value IS NOT NULL")
        for f, v in zip([0.1, 0.5, 0.9], r["values"], strict=True):
            assert abs(values.where(F.col("value") <= v).count() / values.count() - f) <= sketches.RANK_ERROR + 1e-3
        assert r["items"][0]["item"] == 7 and abs(r["items"][0]["count"] - part.where("client = 7").count()) <= sketches.COUNT_ERROR * n


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([(START, "a", None, None), (None, "a", None, float("nan"))], "ts timestamp_ntz, kind string, client long, value double")
    stored = sketches.daily(rows, "ts", ["kind"], "client", "value", "client")
    got = sketches.answers(sketches.rolled(stored, ["kind"]), [0.5], 3).where("level = 0").first()
    assert (got.n, got.distinct, got["values"]) == (2, 0, None)
    assert sketches.daily(rows.where("false"), "ts", ["kind"], "client", "value", "client").count() == 0


# ---------------------------------------------------------------- recursion

def test_gallop_asks_few_pages_and_finds_the_last(spark):
    lasts = {"none": 0, "one": 1, "eight": 8, "nine": 9, "many": 57, "more": 1000, "gap": 5}
    pages = [(k, p) for k, n in lasts.items() for p in range(1, n + 1)] + [(None, 1), ("gap", 7), ("gap", 7), ("other", 1)]
    labels = spark.createDataFrame([(k,) for k in [*lasts, None, "one"]], "label string")
    got = {r.label: r.last_page for r in gallop.last_pages(spark.createDataFrame(pages, "label string, page int"), labels).collect()}
    assert got == {**lasts, None: 0}
    assert gallop.last_pages(spark.createDataFrame(pages, "label string, page int"), labels, most=10).where("label = 'many'").first().last_page == 10
    assert gallop.last_pages(spark.createDataFrame([], "label string, page int"), labels.where("false")).count() == 0
    assert records.discover(lambda p: p <= 57) == got["many"]


# ---------------------------------------------------------------- variants

TEXTS = [None, "", "{", '{"a": 1, "a": 2}', '{"k": 3, "s": "x", "t": ["p", null, 2], "o": {"d": [{"q": 1}, {"q": "z"}]}}', '{"k": "4", "t": "[\\"u\\", \\"v\\"]", "b": true, "n": null}', '{"k": 1.5, "t": " one "}', "[1, 2]", '"text"', "7"]


def test_unknown_shapes(spark):
    rows = shapes.parsed(spark.createDataFrame(list(enumerate(TEXTS)), "id int, props string"), "props")
    got = {r.id: r for r in shapes.typed(rows, "shape", {"k": ("$.k", "bigint"), "q": ("$.o.d[1].q", "string")}).withColumn("list", shapes.as_list(F.try_variant_get("shape", "$.t", "variant"))).collect()}
    assert [got[i].k for i in (0, 2, 4, 5, 6, 7)] == [None, None, 3, 4, 1, None] and got[4].q == "z"
    assert [got[i]["list"] for i in (0, 4, 5, 6, 9)] == [None, ["p", None, "2"], ["u", "v"], [" one "], None]
    found = {(r.path, r.kind): r.n for r in shapes.inventory(rows, "shape").collect()}
    want: dict = {}

    def walk(path, v):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        want[path, kind] = want.get((path, kind), 0) + 1
        for k, x in v.items() if isinstance(v, dict) else [("", x) for x in v] if isinstance(v, list) else ():
            walk(f"{path}.{k}" if isinstance(v, dict) else f"{path}[*]", x)

    for t in TEXTS:
        try:
            if t and t.count('"a"') < 2:
                walk("$", json.loads(t))
        except ValueError:
            pass
    assert found == want
    assert shapes.inventory(rows.where("false"), "shape").count() == 0


# ---------------------------------------------------------------- repairs and comparisons

def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_only_buckets_with_repairs_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"n{i}", "a", None if i % 3 else i) for i in range(300)] + [(None, "nobody", "a", 1), (5, "again", "b", 2)]
    shape = spark.createDataFrame(rows, "id long, name string, city string, size long")
    buckets.create(shape, path, "id", 16)
    before = _files(path)
    fixes = spark.createDataFrame([(5, "new", None), (7, None, 70), (7, None, 71), (8, None, None), (9, "a", 9), (1000, "far", 1), (None, "x", 1)], "id long, city string, size long")
    told = buckets.merge(spark, path, shape.schema, fixes, "id", ["city", "size"], 16)
    want = {(i, n, "new" if i == 5 else c, 70 if i == 7 else s) for i, n, c, s in rows} | {(1000, None, "far", 1)}
    assert {tuple(r) for r in buckets.load(spark, path, shape.schema).drop("bucket").collect()} == want
    assert (told["changed"], told["added"]) == (3, 1)  # both rows of 5, and 7
    after = _files(path)
    changed = {k.split("/")[0] for k in before.keys() ^ after.keys()} | {k.split("/")[0] for k in before.keys() & after.keys() if before[k] != after[k]}
    assert changed == {f"bucket={b}" for b in told["buckets"]} and len(changed) <= 3
    assert buckets.merge(spark, path, shape.schema, fixes, "id", ["city", "size"], 16) == {"changed": 0, "added": 0, "buckets": []}
    assert _files(path) == after
    assert buckets.merge(spark, path, shape.schema, fixes.where("false"), "id", ["city", "size"], 16)["buckets"] == []


def test_checksum_tree(spark):
    draw = random.Random(1)
    rows = [(i, f"v{i % 50}", None if i % 7 == 0 else i) for i in range(6000)]
    changed = {i: r for i, r in enumerate(rows)}
    for i in draw.sample(range(6000), 12):
        changed[i] = (i, None, rows[i][2])
    del changed[17]
    changed[7000] = (7000, "new", 1)
    a, b = spark.createDataFrame(rows, "k long, x string, y long"), spark.createDataFrame(list(changed.values()), "k long, x string, y long")
    by_row = lambda rows: sorted(map(str, rows))
    want = by_row(records.compared(a, b, "k", ["x", "y"]).collect())
    assert by_row(differing.differences(a, b, "k", ["x", "y"]).collect()) == want and len(want) > 14
    marked = [differing._marked(t, "k", ["x", "y"]) for t in (a, b)]
    for rows_told, levels in ((10, 1), (10 ** 7, 2)):
        known, level = differing.differing_ranges(*marked, rows_told)
        assert level == levels and known.count() <= 14
    assert differing._ranges(marked[0], level, known).count() <= 14  # only rows that differ, at the finer level
    assert differing.differences(a, a, "k", ["x", "y"]).count() == 0
    nothing = a.where("false")
    assert differing.differences(nothing, nothing, "k", ["x"]).count() == 0 and differing.differences(a.where("k < 3"), nothing, "k", ["x"]).count() == 3
    swapped = spark.createDataFrame([(1, None, "p")], "k long, x string, y string"), spark.createDataFrame([(1, "p", None)], "k long, x string, y string")
    assert differing.differences(*swapped, "k", ["x", "y"]).count() == 2


# ---------------------------------------------------------------- streams

def _write(spark, rows, shape, path, n):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    return n


def test_first_seen_again_over_restarts(spark, tmp_path):
    """Three runs from one checkpoint give what one run gives; forgotten keys are new again; out of order within the watermark."""
    shape = "k string, t timestamp_ntz"
    minutes = lambda k, *at: [(k, START + datetime.timedelta(minutes=m)) for m in at]
    parts = [minutes("a", 0, 5, 3) + minutes("b", 1), minutes("a", 12, 40) + minutes(None, 45, 44), minutes("b", 50) + minutes("c", 200) + [("d", None)]]
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    seen = []
    for part in parts:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(path)
        runs = expiring.first_seen_again(streams.channel(spark, path, spark.read.parquet(path).schema), "k", "t", "10 minutes", "5 minutes")
        streams.appended(runs, out, state)
        seen.append(spark.read.schema(runs.schema).parquet(out).count())
    minute = lambda t: int((t - START).total_seconds() // 60)
    got = sorted((str(r.key), minute(r.first), minute(r.last), r.n) for r in spark.read.schema(runs.schema).parquet(out).collect())
    assert got == [("None", 44, 45, 2), ("a", 0, 12, 4), ("a", 40, 40, 1), ("b", 1, 1, 1), ("b", 50, 50, 1)]
    assert seen[0] == 0 and seen[-1] == 5


def test_late_rows_and_two_streams(spark, tmp_path):
    """Rows replayed in the order of their arrival: every row is on time or late, and all pairs of on-time rows are found."""
    draw = random.Random(4)

    def rows(n):
        for i in range(n):
            t = draw.randrange(0, 20_000)
            delay = draw.choice([0, 5, 50, 590, 601, 4000])
            yield i, draw.choice(["hot", "hot", "b", None]), None if i % 20 == 0 else START + datetime.timedelta(seconds=t), None if i % 31 == 0 else START + datetime.timedelta(seconds=t + delay)

    shape, tables = "id long, k string, t timestamp_ntz, arrived timestamp_ntz", {"l": [*rows(150)], "r": [*rows(120)]}
    is_late = lambda r: r[2] is None or r[3] is not None and (r[3] - r[2]).total_seconds() > 600
    for name, table in tables.items():
        table.sort(key=lambda r: (r[3] or r[2] or START))
        for k in range(0, len(table), 50):
            spark.createDataFrame(table[k:k + 50], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: streams.channel(spark, f"{tmp_path}/{name}", spark.read.parquet(f"{tmp_path}/{name}").schema, depth=1)
    for name, table in tables.items():
        counts = [streams.drained(f(read(name), "t", "arrived", "10 minutes"), f"{tmp_path}/{f.__name__}-{name}").count() for f in (late.on_time, late.late_rows)]
        assert counts == [sum(not is_late(r) for r in table), sum(map(is_late, table))]
    sides = [late.on_time(read(name), "t", "arrived", "10 minutes") for name in tables]
    pairs = streams.drained(late.matched(*sides, "k", "t", "t", "5 minutes", "10 minutes").select("l.id", F.col("r.id").alias("other")), f"{tmp_path}/pairs")
    want = sorted((a[0], b[0]) for a in tables["l"] for b in tables["r"] if not is_late(a) and not is_late(b) and a[1] is not None and a[1] == b[1] and 0 <= (b[2] - a[2]).total_seconds() <= 300)
    assert sorted(tuple(r) for r in pairs.collect()) == want and len(want) > 20


# ---------------------------------------------------------------- search

def test_index_of_trigrams(spark, tmp_path):
    draw = random.Random(3)
    texts = [(i, "".join(draw.choice("aabé 漢😀") for _ in range(draw.randrange(0, 60)))) for i in range(150)] + [(500, None), (501, "aaaaaa"), (502, "ab")]
    rows = spark.createDataFrame(texts, "id long, text string")
    path = str(tmp_path / "index")
    postings.build(rows, "id", "text", path, 8)
    index = spark.read.parquet(path)
    for q in ("aab", "aaaa", "é 漢", "a😀a", "b aé", "abababab", "漢漢漢"):
        got = {r.key: (r.first, r.n) for r in postings.hits(index, q, 8).collect()}
        assert got == {i: (t.find(q), sum(t.startswith(q, k) for k in range(len(t)))) for i, t in texts if t and q in t}
        assert {r.id: r.score for r in postings.search(index, rows, "id", q, 8).collect()} == {i: 1000 - first for i, (first, _) in got.items()}
    plan = postings.hits(index, "aab", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan and "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan
    with pytest.raises(ValueError):
        postings.hits(index, "ab")
    postings.build(rows.where("false"), "id", "text", str(tmp_path / "none"))


def _shuffled(spark):
    """Bytes that each stage so far has written for a shuffle."""
    bus, gateway = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._gateway
    bus.waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_building_the_index_writes_little_more_than_the_texts(spark, tmp_path):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghijé") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    texts = [(i, " ".join(draw.choice(words) for _ in range(500))) for i in range(300)]
    rows, path = spark.createDataFrame(texts, "id long, text string"), tmp_path / "index"
    before = _shuffled(spark)
    postings.build(rows, "id", "text", str(path), 8)
    made = sum(n for stage, n in _shuffled(spark).items() if stage not in before)
    size = sum(p.stat().st_size for p in path.rglob("*.parquet"))
    assert size and size + made < 2.5 * sum(len(t) for _, t in texts)  # dealt by a shuffle, with positions as they are: 11 bytes a character


def test_runs_of_the_index(spark, tmp_path):
    """Texts on both sides of a run's end, empty ones between, repeated and missing keys, one text longer than a run."""
    draw = random.Random(6)
    texts = [(draw.choice([None, 1, 2, i]), draw.choice([None, "", "a", "ab", "aab" * draw.randrange(99), "".join(draw.choice("ab") for _ in range(draw.randrange(40)))])) for i in range(200)]
    postings.build(spark.createDataFrame(texts, "id long, text string").coalesce(2), "id", "text", str(tmp_path / "index"), 8, 150)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.select("run").distinct().count() > 20
    for q in ("aba", "aabaab", "bbb"):
        got = sorted((str(r.key), r.first, r.n) for r in postings.hits(index, q, 8).collect())
        assert got == sorted((str(i), t.find(q), sum(t.startswith(q, k) for k in range(len(t)))) for i, t in texts if t and q in t) and got


def test_places_are_packed_whole():
    wide = "".join(map(chr, range(0x10000, 0x10000 + 70_000)))  # too many code points for a trigram and its place in one number
    for texts in (["abcab", "", "c", "bcabcab", "ab"], [wide, wide[:5], "abc"], ["a"], ["", ""]):
        c, ends = postings._points("".join(texts)), np.cumsum([len(t) for t in texts])
        grams, heads, places = postings._sorted(c, ends)
        want: dict = {}
        for t, end in zip(texts, ends, strict=True):
            for k in range(len(t) - 2):
                want.setdefault(int(postings._numbers(postings._points(t[k:k + 3]))[0]), []).append(end - len(t) + k)
        packed = postings._packed(places, heads)
        assert {g: postings._unpacked(p.as_py()).tolist() for g, p in zip(grams.tolist(), packed, strict=True)} == want
        assert grams.tolist() == sorted(want)
    far = np.cumsum([0, 1, 127, 128, (1 << 14) - 1, 1 << 14, 1 << 21, 1 << 28, (1 << 28) + 5])
    both = postings._packed(np.append(far, far), np.array([0, len(far)]))
    assert [postings._unpacked(p.as_py()).tolist() for p in both] == [far.tolist()] * 2


# ---------------------------------------------------------------- growth

def _plans(monkeypatch, module):
    """Plans of the tables that a module writes, by their names."""
    plans, kept = [], module.kept
    monkeypatch.setattr(module, "kept", lambda rows, name: plans.append((name, rows._jdf.queryExecution().optimizedPlan().toString())) or kept(rows, name))
    return plans


def test_repeated_pages_go_after_they_are_dealt(spark, monkeypatch):
    """Otherwise the task that makes the pages of a small file of labels holds all of them."""
    pages = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "label string, page int")
    seen, kept = [], gallop.kept
    monkeypatch.setattr(gallop, "kept", lambda rows, name: seen.append(rows._jdf.queryExecution().sparkPlan().toString()) or kept(rows, name))
    assert gallop.last_pages(pages, pages.select("label")).first().last_page == 2
    dealt = seen[0].index("RepartitionByExpression") if "RepartitionByExpression" in seen[0] else seen[0].index("Exchange")
    assert "HashAggregate" in seen[0][:dealt] and "HashAggregate" not in seen[0][dealt:]


def test_values_are_parsed_once(spark, monkeypatch):
    rows = shapes.parsed(spark.createDataFrame([(t,) for t in TEXTS], "props string"), "props")
    plans = _plans(monkeypatch, shapes)
    assert shapes.inventory(rows, "shape").count() > 0
    assert ["parse_json" in p.lower() or "parsejson" in p.lower() for _, p in plans] == [True, *[False] * 4]


class _Handle:
    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_key_has_one_timer_however_many_runs(spark):
    handle, runs = _Handle(), expiring._Runs(1000)
    runs.init(handle)
    give = lambda *at: list(runs.handleInputRows(("k",), iter([pd.DataFrame({"at": at})]), handle))
    give(*range(0, 500_000, 5000))
    assert len(handle.rows) == 100 and handle.timers == [1]
    give(-9000)  # earlier than all
    assert handle.timers == [1, -8]
    closed = []
    for handle.now in (-8, 1, 250):
        closed += [r for out in runs.handleExpiredTimer(("k",), handle, None) for r in out["first"]]
        assert all(h + 1000 > handle.now * 1000 for _, h, _ in handle.rows) and handle.timers[-1] == min(-(-(h + 1000) // 1000) for _, h, _ in handle.rows)
    handle.now = 10 ** 6
    closed += [r for out in runs.handleExpiredTimer(("k",), handle, None) for r in out["first"]]
    assert closed == [-9000, *range(0, 500_000, 5000)] and not handle.rows


def test_streams_meet_by_key_and_time(spark):
    """All pairs at the edges of the two hours and of bins, before 1970 too; a key with many rows is no single group of the join."""
    at = lambda s: datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)
    hour, shape = 3600, "id long, k string, t timestamp_ntz"
    times = [-5 * hour, -2 * hour, -1, 0, 1, hour, 2 * hour - 1, 2 * hour, 2 * hour + 1, 4 * hour]
    left, right = ([(i, "hot", at(t)) for i, t in enumerate(times)] + [(99, None, at(0))] for _ in range(2))
    pairs = late.matched(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), "k", "t", "t", "2 hours", "1 hour")
    want = sorted((i, j) for i, a in enumerate(times) for j, b in enumerate(times) if 0 <= b - a <= 2 * hour)
    assert sorted(map(tuple, pairs.select("l.id", F.col("r.id").alias("other")).collect())) == want
    assert "_l_bin" in pairs._jdf.queryExecution().optimizedPlan().toString()
