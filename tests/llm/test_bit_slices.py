"""Places within groups against brute force: a hot group over many entries, nulls, ties, repeated rows, wide keys, empty tables."""

import random

import numpy as np
import pytest

from tessera.llm import bit_slices

SHAPE = "g long, h long, a long, b long, x long, y long, other string"


def brute(rows, places):
    last = lambda v: (v is None, v or 0)
    groups, out = {}, []
    for g, h, a, b, x, y, _ in rows:
        groups.setdefault((g, h), []).append((a is None, -(a or 0), *last(b), last(x), last(y), (g, h, a, b, x, y)))
    for group in groups.values():
        group.sort(key=lambda r: r[:-1])
        keys = sorted({r[:4] for r in group})
        for pos, r in enumerate(group):
            place = keys.index(r[:4]) + 1
            if place <= places:
                out.append((*r[-1], place, pos + 1, sum(q[:4] == r[:4] for q in group)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("step", "wide"), [(1, 9), (4, 9), (3, 1 << 40)])
def test_first_places(spark, step, wide):
    draw = random.Random(wide)
    some = lambda *v: draw.choice([None, *v])
    rows = [(7, None, some(*range(4)), some(-wide, 0, 3, wide), some(1, 2), some(5, 6), "s") for _ in range(6000)]  # a third of the rows and more entries than one
    rows += [(draw.randrange(300), some(0, 1), some(*range(-2, 6)), some(*range(5)), some(*range(9)), some(*range(9)), None) for _ in range(6000)]
    rows += [(1, 1, 5, 5, 5, 5, "same")] * 40 + [(None, None, None, None, None, None, None)] * 3
    given = spark.createDataFrame(rows, SHAPE).repartition(6)
    got = bit_slices.first_places(given, ["g", "h"], [("a", True), ("b", False)], ["x", "y"], 3, step)
    assert got.columns == ["g", "h", "a", "b", "x", "y", "place", "pos", "tied"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 3)


def test_no_rows_one_value_and_no_groups(spark):
    rows = spark.createDataFrame([(1, 1, 2, 2, 3, 3, "a")] * 4, SHAPE)
    got = [tuple(r) for r in bit_slices.first_places(rows, ["g"], [("a", True)], ["x"]).collect()]
    assert sorted(got) == [(1, 2, 3, 1, n, 4) for n in range(1, 5)]
    assert bit_slices.first_places(rows.where("false"), ["g"], [("a", True)], ["x"]).count() == 0


def test_counts_come_from_the_bitmaps(spark):
    """Entries without the last slice's bits lead to other places."""
    rows = spark.createDataFrame([(1, None, k % 8, 0, k, 0, "") for k in range(100)], SHAPE)
    keys = bit_slices.keys_of(rows, [("a", False)])
    assert (keys.bits, keys.columns) == (3, [(False, 0, 7, False)])
    entries = bit_slices.index(rows.select("g", "a", "x"), ["g"], [("a", False)], keys, 8)
    from pyspark.sql import functions as F

    found = lambda e: [(tuple(map(bytes, r.frontier)), tuple(r.sums)) for r in bit_slices.descend(e, ["g"], keys, 2).collect()]
    assert found(entries) == [((b"\x00", b"\x20"), (13, 13))]
    assert found(entries.withColumn("s2", F.col("s1"))) != found(entries)


def test_bits_of_a_key():
    keys = bit_slices.Keys([(True, 2, 9, True), (False, -(1 << 62), (1 << 63) - 1, False)])
    a, b = np.array([9, 2, 0]), np.array([-(1 << 62), (1 << 63) - 1, 0])
    bits = np.array(keys.slices([a, b], [np.array([False, False, True]), np.zeros(3, bool)])).T
    value = [int("".join(map(str, r.astype(int))), 2) for r in bits]
    assert keys.bits == 4 + 64 and value == [0, (7 << 64) + (1 << 63) - 1 + (1 << 62), (8 << 64) + (1 << 62)]
