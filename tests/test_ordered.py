"""Frames over one order and joins by time against brute force: hot keys, nulls, ties, empty tables, few and many parts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, temporal

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data():
    draw = random.Random(5)
    return [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([None, *range(40)]), i, draw.choice([None, *range(-5, 9)])) for i in range(400)]


SHAPE = "g string, t int, id int, v int"


def in_order(rows, grouped):
    low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    key = lambda r: ((r[0] is not None, r[0] or ""),) if grouped else ()
    return sorted(rows, key=lambda r: (*key(r), low(r[1]), r[2]))


@pytest.mark.parametrize("parts", [1, 11])
@pytest.mark.parametrize("within", [[], ["g"]])
def test_numbers_sums_and_tiles(spark, data, within, parts):
    rows = spark.createDataFrame(data, SHAPE)
    order = [F.col("t"), F.col("id")]
    want, groups = {}, {}
    for r in in_order(data, bool(within)):
        groups.setdefault(r[0] if within else 0, []).append(r)
    for group in groups.values():
        total, seen = 0, False
        small, more = divmod(len(group), 3)
        tiles = [k + 1 for k in range(3) for _ in range(small + (k < more))]
        for n, r in enumerate(group):
            total, seen = total + (r[3] or 0), seen or r[3] is not None
            want[r[2]] = (n + 1, total if seen else None, tiles[n], group[n - 2][2] if n > 1 else None, sum(x[3] or 0 for x in group[max(0, n - 2):n + 2]))
    got = {r.id: [r.n] for r in ordered.numbered(rows, order, within, parts=parts).collect()}
    for r in ordered.running(rows, order, {"s": F.col("v")}, within, parts).collect():
        got[r.id].append(r.s)
    for r in ordered.tiled(rows, order, 3, within, parts=parts).collect():
        got[r.id].append(r.tile)
    columns = {"back": lambda w, f: F.lag("id", 2).over(w), "near": lambda w, f: F.sum(F.coalesce("v", F.lit(0))).over(f)}
    for r in ordered.framed(rows, order, 2, 1, columns, within, chunk=5, parts=parts).collect():
        got[r.id] += [r.back, r.near]
    assert {k: tuple(v) for k, v in got.items()} == want
    assert ordered.numbered(rows.where("false"), order, within, parts=parts).count() == 0


def test_the_largest_task_does_not_follow_the_rows(spark, data):
    rows = spark.createDataFrame(data, SHAPE)
    held = ordered.dealt(rows, [F.col("t"), F.col("id")], ["g"], 20)
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert max(sizes) < 60 and len(sizes) > 15  # "hot" has 160 rows
    plan = ordered.running(rows, [F.col("t")], {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum(_v_s" in plan and "[_part" in plan.split("Window [sum(_v_s")[1].split("\n")[0]


def test_quantiles_are_exact(spark, data):
    rows = spark.createDataFrame(data, SHAPE)
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = rows.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]
    assert [r.value for r in ordered.quantiles(rows, "v", at, parts=5).orderBy("fraction").collect()] == want
    assert [r.value for r in ordered.quantiles(rows.where("false"), "v", [0.5]).collect()] == [None]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_as_of(spark, forward, equal):
    draw = random.Random(3)
    when = lambda: None if draw.random() < 0.05 else START + datetime.timedelta(minutes=draw.randrange(60))
    key = lambda: draw.choice(["hot", "hot", "x", None])
    left = [(i, key(), when()) for i in range(150)] + [(7, "hot", START)] * 2
    right = [(i, key(), when()) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k string, at timestamp_ntz"), spark.createDataFrame(right, "r int, k string, was timestamp_ntz")
    for parts, within in ((1, None), (9, None), (9, "3 minutes")):
        got = temporal.as_of(a, b, ["k"], "at", "was", "r", forward, equal, within, parts)
        found = sorted((r.id, str(r.k), str(r["at"]), r.match.r if r.match else -1) for r in got.collect())
        want = []
        for i, k, t in left:
            fits = [(w, r) for r, q, w in right if None not in (k, t, w) and q == k and (equal and w == t or (w > t if forward else w < t))]
            best = (min if forward else max)(fits, default=(None, -1))
            far = within and fits and abs(best[0] - t) > datetime.timedelta(minutes=3)
            want.append((i, str(k), str(t), -1 if far else best[1]))
        assert found == sorted(want)
    assert temporal.as_of(a, b.where("false"), ["k"], "at", "was", "r").where("match IS NULL").count() == len(left)
    assert temporal.as_of(a.where("false"), b, ["k"], "at", "was", "r").count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("full", [3, 1 << 16])
def test_overlaps(spark, by, full):
    draw = random.Random(9)

    def spans(n):
        for i in range(n):
            a = None if draw.random() < 0.05 else START + datetime.timedelta(seconds=draw.choice([draw.randrange(86400), 3600]))
            yield i, draw.choice(["hot", "hot", "x", None]), a, a and a + datetime.timedelta(seconds=draw.choice([-5, 0, 1, 60, 4000, 90000, 10_000_000]))

    left, right = [*spans(90)], [*spans(70)]
    a, b = (spark.createDataFrame(x, "id int, k string, s timestamp_ntz, e timestamp_ntz") for x in (left, right))
    found = temporal.overlaps(a, b, by, ("s", "e"), ("s", "e"), "10 minutes", full)
    got = sorted((r.l.id, r.r.id) for r in found.collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] and (not by or x[1] is not None and x[1] == y[1]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.overlaps(a.where("false"), b, by, ("s", "e"), ("s", "e")).count() == 0


def test_ranges_of_numbers(spark):
    draw = random.Random(4)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    points = [(i, draw.choice([*odd[:2], draw.uniform(-50, 50)])) for i in range(120)]
    ranges = [(i, a, draw.choice([None, a, a + draw.choice([0, 0.5, 3, 40, -1])])) for i, a in enumerate(draw.uniform(-60, 60) for _ in range(80))]
    a, b = spark.createDataFrame(points, "id int, x double"), spark.createDataFrame(ranges, "id int, low double, high double")
    got = sorted((r.l.id, r.r.id) for r in temporal.overlaps(a, b, [], ("x", "x"), ("low", "high"), 2.0).collect())
    assert got == sorted((i, j) for i, x in points for j, low, high in ranges if None not in (x, low, high) and low <= x <= high) and got


def test_sessions(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["hot", "hot", "x", None]), None if i % 17 == 0 else START + datetime.timedelta(minutes=draw.randrange(900))) for i in range(200)]
    got = sorted((str(r.k), r.started, r.ended, r.n) for r in temporal.sessions(spark.createDataFrame(rows, "id int, k string, t timestamp_ntz"), "k", "t", "10 minutes", "id", parts=9).collect())
    want = []
    for k in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == k and r[2])
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] >= datetime.timedelta(minutes=10):
                want.append((str(k), run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((str(k), run[0], run[-1], len(run)))
    assert got == sorted(want)


def test_repeated_rows_begin_one_session(spark):
    """Rows that are equal in the whole order: the one that begins a run may come from another task than its copy."""
    hour = F.expr("INTERVAL 1 HOUR")
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + hour * F.floor((F.col("id") + 1) / 2)
    # A chunk of framed ends between the copies of row 65535.
    rows = spark.range((1 << 16) + 3).crossJoin(spark.range(8).withColumnRenamed("id", "k")).select("k", at.alias("t"), F.floor((F.col("id") + 1) / 2).alias("tie"))
    found = temporal.sessions(rows, "k", "t", "10 minutes", "tie", parts=5)
    want = rows.groupBy("k", F.col("t").alias("started")).agg(F.max("t").alias("ended"), F.count(F.lit(1)).alias("n")).select("k", "started", "ended", "n")
    assert found.select("k", "started", "ended", "n").exceptAll(want).count() == 0 and found.count() == want.count()
