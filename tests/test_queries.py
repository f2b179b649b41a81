"""Every registered query of the engine against its SQL twin on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import tessera.plans.queries
import tessera.plans.resumed
import tessera.plans.shop
import tessera.plans.stored
import tessera.plans.timed  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    if name in ORACLES:
        duck.execute(ORACLES[name])
        want = rows([c[0] for c in duck.description], duck.fetchall())
        assert got == want


def test_scans_prune_columns_and_push_filters(spark):
    plan = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan and "l_comment" not in plan
    plan = QUERIES["resume_anti"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan and "EqualTo(l_returnflag,R)" in plan


HARD = ['a,b', 'say "so"', '"', 'two\nlines', 'a\r\nb', '  led', 'trailed \t', 'back\\slash\\', '\\"', "#x", "é 中 \u2028", "null"]


@pytest.mark.parametrize("name", ["csv_roundtrip", "jsonl_roundtrip"])
def test_roundtrips_keep_every_text(spark, tmp_path, name):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(HARD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == rows


def test_cut_off_pages_and_whole_union(spark, tmp_path):
    html = ["<html>x</html>", "<html>cut", None, "<HTML></HTML>"]
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.url for r in QUERIES["failed_urls"](spark, str(tmp_path)).orderBy("url").collect()] == ["u1", "u2"]
    for table, column, keys in (("customer", "c_nationkey", [7]), ("supplier", "s_nationkey", [7, 8]), ("nation", "n_nationkey", [7, 8, 9])):
        spark.createDataFrame([(k,) for k in keys], f"{column} long").write.parquet(f"{tmp_path}/{table}.parquet")
    assert sorted((r.path, r.priority) for r in QUERIES["priority_union"](spark, str(tmp_path)).collect()) == [(7, 0), (8, 1), (9, 2)]


@pytest.mark.parametrize("name", ["profile_records", "profile_gold"])
def test_profiles_of_names_that_hold_other_fields(spark, tmp_path, name):
    """Keys of four digits stand in names, where 113 is not the number of projects."""
    con = duckdb.connect()
    spark.createDataFrame([(k, f"Supplier#{k:09d}", 0) for k in (113, 1130, 1131, 2113, 11300)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "Jordan 113", 0)], "n_nationkey int, n_name string, n_regionkey int").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    for table in ("nation", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = QUERIES[name](spark, str(tmp_path))
    con.execute(ORACLES[name])
    want = rows([c[0] for c in con.description], con.fetchall())
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == want and len(want[1]) == 5


def test_highlights_take_in_affixes_and_escape(spark):
    marks = [r.marked for r in QUERIES["search_highlight"](spark, DATA).where("c_custkey = 1").collect()]
    assert len(marks) == 3 and sum('class="ctx"' in m for m in marks) == 1 and sum("&lt;" in m for m in marks) == 1
