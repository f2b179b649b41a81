"""Golden rows and properties of the text and value expressions."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import combos, text, values
from tessera.operators import search


def one(spark, f, *inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, s {kind}")
    return [r.o for r in rows.select("i", f(F.col("s")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(("f", "cases"), [
    (values.minutes_of, {"أقل من دقيقة": 1, "ساعتين": 120, "3 ساعات و 15 دقيقة": 195, "٤٤ دقيقة": 44, "": 0, None: 0, "غير معروف": 0, "عشرة أيام": 14400, "7": 0}),
    (values.decimal_of, {"100.00%": 100.0, "": 0.0, None: 0.0, "$1,250.5": 1250.5, "1.2.3": 0.0}),
    (values.integer_of, {"113 مشروع": 113, "": 0, None: 0, "٤٤": 44}),
    (values.date_of, {"01 يونيو 2023": datetime.date(2023, 6, 1), "2023-06-01": datetime.date(2023, 6, 1), "منذ 2021": datetime.date(2021, 1, 1), "31 فبراير 1999": None, "": None, None: None, "٣ أغسطس ٢٠٢٢": datetime.date(2022, 8, 3)}),
    (text.normalize_label, {"إكمال  المشـاريع ": "اكمال المشاريع", None: None, "": "", "a b": "a b"}),
    (text.initials, {"Ada Lovelace": "AL", "": "?", None: "?", " bob ": "B", "a b c": "AC"}),
    (text.first_word, {"Ada L": "Ada", "  ": None, None: None}),
    (text.strip_lead, {"- Engineer": "Engineer", "مبرمج": "مبرمج", "••": ""}),
    (text.slug, {"https://a/u/ada": "ada", "https://a/u/ada/": "ada"}),
    (text.avatar_url, {"//a": "https://a", " ": None, None: None, "http://a": "http://a"}),
    (text.escape_html, {"<a href='x'>&\"": "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"}),
])
def test_golden(spark, f, cases):
    assert one(spark, f, *cases) == list(cases.values())


def test_fuzzy_and_literal_scores(spark):
    assert one(spark, lambda c: search.fuzzy_score(c, "abc"), "xaxbxc", "abc", "acb", "") == [28, 30, None, None]
    assert one(spark, lambda c: search.literal_score(c, "ab"), "ab", "xxxxxab", "ba") == [1000, 995, None]


def fuzzy(needle, hay):
    """Plain model of the greedy subsequence score."""
    at, gaps = 0, 0
    for c in hay:
        if at == len(needle):
            break
        if c == needle[at]:
            at += 1
        elif at:
            gaps += 1
    return 10 * len(needle) - gaps if at == len(needle) else None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcé", max_size=12), min_size=1, max_size=20), st.text("abcé", min_size=1, max_size=4))
def test_fuzzy_property(spark, names, needle):
    assert one(spark, lambda c: search.fuzzy_score(c, needle), *names) == [fuzzy(needle, n) for n in names]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("إأا ـب\t\n", max_size=12), min_size=1, max_size=20))
def test_normalising_twice_changes_nothing(spark, names):
    once = one(spark, text.normalize_label, *names)
    assert one(spark, text.normalize_label, *once) == once
    assert all("ـ" not in x and "  " not in x and x == x.strip() for x in once)


def test_search_index_and_marks():
    norm, places = search.with_index("مُحمّد")
    assert norm == "محمد" and len(places) == 4
    assert search.marked("Ada", "") == "Ada"
    assert search.marked("<Ada>", "da") == "&lt;A<mark>da</mark>&gt;"
    assert search.marked("Ada", "xa") is None
    assert search.marked("a-b", "ab") == '<mark>a</mark><mark class="ctx">-</mark><mark>b</mark>'
    assert search.marked("a-b", "ab", exact=True) is None


def test_search_ranks_and_keeps_order(spark):
    rows = spark.createDataFrame([(0, "xab"), (1, "ab"), (2, "a b"), (3, "q")], "pos int, norm string")
    assert [(r.pos, r.score) for r in search.search(rows, " AB ").collect()] == [(1, 1000), (0, 999), (2, 19)]
    assert [r.pos for r in search.search(rows, "ab", exact=True).collect()] == [1, 0]
    assert [r.pos for r in search.search(rows, " ").collect()] == [0, 1, 2, 3]


def test_combinations(spark):
    rows = combos.combinations(spark, {"skills": ["sql"], "country": ["jo", "sa"]})
    assert rows.count() == 1 + 5 + 20 + 1 + 2
    assert [r.dim for r in rows.orderBy("seq").limit(2).collect()] == ["base", "rating"]


def test_default_combinations(spark):
    rows = combos.combinations(spark).orderBy("seq").collect()
    assert len(rows) == 336 and len({(r.dim, r.value) for r in rows}) == 336
    assert list(dict.fromkeys(r.dim for r in rows)) == ["base", "rating", "titles", "skills", "country"]
    assert [rows[26].value, rows[81].value, rows[82].value, rows[-1].value] == ["IOS", "تعديل-الصوت", "jo", "hk"]


def test_kilobytes_credit_and_penalty(spark):
    row = spark.range(1).select(
        text.kilobytes(F.lit(1536)).alias("a"), text.kilobytes(F.lit(0)).alias("b"), text.progress_credit(F.lit(5), F.lit(10)).alias("c"), text.progress_credit(F.lit(20), F.lit(0)).alias("d"),
        text.penalty_seconds(F.lit(1), F.lit(1.0)).alias("e"), text.penalty_seconds(F.lit(9), F.lit(0.5)).alias("f")).first()
    assert tuple(row) == ("1.5 KB", "0.0 KB", 0.5, 0.5, 30.0, 120.0)


def test_minutes_keep_their_digits(spark):
    rows = spark.createDataFrame([(0,), (59,), (5999,), (6000,), (600061,), (None,)], "s long")
    assert [r.c for r in rows.select(text.minutes_seconds(F.col("s")).alias("c")).collect()] == ["00:00", "00:59", "99:59", "100:00", "10001:01", None]
