"""Record operators: dedup, resume, upsert, paging; nulls, ties, empty tables."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import leaderboard, metrics, quality, records
from tessera.plans import stages
from tessera.plans.engine import Engine, pages_by_url
from tessera.plans.queries import LISTING_PAGE, PROFILE_PAGE
from tessera.schemas import LISTING
from tessera.sources import dom, files, pages
from tessera.streaming import streams


def test_first_and_last(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", 0, None)], "k string, seq int, v string")
    assert sorted((r.k or "", r.v or "") for r in records.first_per_key(rows, "k", "seq").collect()) == [("", "z"), ("a", "x"), ("b", "")]
    assert sorted((r.k or "", r.v or "", r.position) for r in records.last_per_key(rows, "k", "seq").collect()) == [("", "z", 3), ("a", "y", 1), ("b", "", 0)]
    assert records.first_per_key(rows.where("false"), "k", "seq").count() == 0


def test_resume_retries_failures(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "profile_url string")
    done = spark.createDataFrame([("a", "<p>"), ("b", None)], "profile_url string, html string")
    assert sorted(r.profile_url for r in records.remaining_fetches(urls, done).collect()) == ["b", "c"]


def test_fix_up_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", "", None), ("b", "t", "1.0"), ("c", None, "2.0")], "profile_url string, title string, rank string")
    parsed = spark.createDataFrame([("a", "new", 4.5), ("c", "", None)], "profile_url string, title string, rating double")
    assert sorted(tuple(r) for r in records.fix_up(rows, parsed).collect()) == [("a", "new", "4.5"), ("b", "t", "1.0"), ("c", None, "2.0")]
    assert sorted(r.profile_url for r in records.needs_fixup(rows).collect()) == ["a", "c"]


def test_limit_modes(spark):
    rows = spark.range(5)
    assert [records.limited(rows, n, seeded, "id").count() for n, seeded in ((0, True), (0, False), (2, True), (None, False))] == [5, 0, 2, 5]


@pytest.mark.parametrize(("pages_there", "want"), [(57, 57), (0, 0), (1, 1), (100, 100), (6400, 6400), (20000, 12799)])
def test_discovery_probes(pages_there, want):
    assert records.discover(lambda p: p <= pages_there) == want


def test_pages_guard_against_counting_down(spark):
    jobs = spark.createDataFrame([("a", 2), ("b", 0), ("c", -1)], "label string, last_page int")
    assert sorted((r.label, r.page) for r in records.pages_of(jobs, "last_page").collect()) == [("a", 1), ("a", 2)]


def test_quality_predicates_stay_apart(spark):
    rows = spark.createDataFrame([("", 0, [], "ok"), (None, None, None, None), ("x", 1, ["s"], "blocked")], "title string, n int, skills array<string>, conf string")
    rows = rows.withColumn("status", quality.status(F.col("conf"), F.col("title")))
    assert [r.status for r in rows.collect()] == ["parse_miss", "parse_miss", "blocked"]
    found = {(r.scope, r.field): r.nulls for r in quality.null_profile(rows, ("title", "n", "skills")).collect()}
    assert found["all", "title"] == 1 and found["all", "skills"] == 2 and found["ok", "title"] == 0
    assert [r.missing for r in quality.missing_fields(rows, ("title", "n")).collect()] == [3, 3, 0]


def test_rates():
    assert metrics.PHASES[0] == "followup"


def test_rates_guard_zero(spark):
    row = spark.range(1).select(metrics.rate(F.lit(5), F.lit(0)).alias("a"), metrics.repair_rate(F.lit(0), F.lit(0)).alias("b"), metrics.average_missing(F.lit(3), F.lit(2)).alias("c")).first()
    assert tuple(row) == (0.0, 100.0, 1.5)


def test_typed_rows_guard_absent_and_bad(spark):
    rows = leaderboard.typed(spark.createDataFrame([("NaN", "x"), ("7.5", None)], "success_score string, rehire_rate string"))
    assert [(r.success_score, r.rehire_rate, r.employment_rate, r.skills) for r in rows.collect()] == [(0.0, 0.0, 0.0, []), (7.5, 0.0, 0.0, [])]


def test_histogram_of_equal_values(spark):
    assert [tuple(r) for r in leaderboard.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,), (-1.0,)], "x double"), "x", 10).collect()] == [(0, 2)]


@pytest.mark.parametrize("parts", [1, 7])
def test_rank_in_parts(spark, parts):
    """Ties, nulls and NaN; with many parts as with one."""
    values = [(float(k % 17) if k % 11 else None, f"u{k:03}") for k in range(300)] + [(float("nan"), "n"), (3.0, None), (3.0, None), (float("inf"), "i")]
    rows = spark.createDataFrame(values, "success_score double, profile_url string").repartition(5)
    got = leaderboard.ranked(rows, parts=parts)
    want = rows.orderBy(F.desc("success_score"), "profile_url").collect()
    found = got.orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, len(values) + 1))
    assert [(str(r.success_score), r.profile_url) for r in found] == [(str(r.success_score), r.profile_url) for r in want]
    assert leaderboard.ranked(rows.where("false")).count() == 0


def test_table_rows_and_bands(spark):
    rows = spark.createDataFrame([(1, 85.0, 96.0, 45.0, ["a", "b"]), (2, 30.0, 60.0, 85.0, None), (3, 50.0, 80.0, 60.0, [])], "rank int, success_score double, completion_rate double, ontime_delivery_rate double, skills array<string>")
    got = [(r.skills_str, r.score_band, r.completion_band, r.ontime_band, r.odd) for r in leaderboard.table_rows(rows).orderBy("rank").collect()]
    assert got == [("a, b", "high", "high", "low", True), (None, "low", "low", "high", False), ("", None, None, None, True)]
    close = leaderboard.distribution(spark.range(1, 1001), "id", 10000).first()
    assert (close.low, close.q1, close.median, close.q3, close.high) == (1, 250, 500, 750, 1000)


def test_until_empty_and_priority(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("b", 1, 0), ("b", 2, 0), ("b", 9, 0), (None, 1, 1), ("c", 1, 1)], "k string, page int, none int")
    assert sorted((r.k, r.page) for r in records.until_empty(rows, "k", "page", F.col("none") == 1, 3).collect()) == [("a", 1), ("b", 1), ("b", 2)]
    first = spark.createDataFrame([("x", 5), ("y", 1)], "path string, modified int")
    second = spark.createDataFrame([("x", 9), ("z", 7), ("z", 8)], "path string, modified int")
    got = records.by_priority([first, second], "path", F.col("path") == "y", "modified").collect()
    assert [(r.path, r.modified, r.priority) for r in got] == [("y", 1, 0), ("z", 7, 1), ("x", 5, 0)]


def test_bars_and_order(spark):
    bars = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 2, 3)], "name string, last_update int, created_at int")
    assert metrics.latest_bar(bars).first().name == "c"
    rows = spark.createDataFrame([("parse",), ("else",), ("followup",)], "phase string")
    assert [r.phase for r in metrics.in_order(rows).collect()] == ["followup", "parse", "else"]


# ---------------------------------------------------------------- streams

def _stream_of(spark, path, schema):
    return streams.channel(spark, path, schema)


def test_streams_drain_and_append(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "k string, seq long"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema).coalesce(1).write.parquet(source)
    known = spark.createDataFrame([("b",)], "k string")
    rows = streams.first_seen(_stream_of(spark, source, schema), "k", "seq", known)
    got = {(r.key, r.first, r.again, r.is_new, r.suppressed) for r in streams.drained(rows, f"file://{tmp_path}/seen").collect()}
    assert got == {("a", 1, 1, True, False), ("b", 2, 0, False, True)}
    counts = _stream_of(spark, source, schema).groupBy("k").count()
    assert {(r.k, r["count"]) for r in streams.drained(counts, f"file://{tmp_path}/counts", "complete").collect()} == {("a", 2), ("b", 1)}
    for _ in range(2):  # the second run finds nothing new
        streams.appended(_stream_of(spark, source, schema), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_chained_streams_overlap_and_stop_together(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "k string, seq long"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(source)
    running = streams.chained({
        "extract": (lambda: _stream_of(spark, source, schema), schema), "parse": (lambda rows: rows.withColumn("seq", F.col("seq") * 10), schema)}, f"file://{tmp_path}/chain")
    try:
        for n, more in ((2, None), (3, ("c", 3))):
            if more:
                spark.createDataFrame([more], schema).write.mode("append").parquet(source)
            for _ in range(120):
                for q in running.values():
                    q.processAllAvailable()
                if files.exists(spark, f"file://{tmp_path}/chain/parse/_spark_metadata") and spark.read.schema(schema).parquet(f"file://{tmp_path}/chain/parse").count() == n:
                    break
            assert all(q.isActive for q in running.values())
        assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/chain/parse").collect()} == {("a", 10), ("b", 20), ("c", 30)}
    finally:
        for q in running.values():
            q.stop()


def test_first_failure_stops_the_others(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "k string, seq long"
    spark.createDataFrame([("a", 1)], schema).write.parquet(source)
    good = _stream_of(spark, source, schema).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c1").start()
    bad = _stream_of(spark, source, schema).withColumn("x", F.raise_error(F.lit("no"))).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c2").start()
    with pytest.raises(RuntimeError, match="stage bad failed"):
        streams.guarded({"good": good, "bad": bad})
    assert not good.isActive and not bad.isActive


# ---------------------------------------------------------------- pages

def test_tree_tolerates_bad_markup():
    page = dom.parse('<ul><li class="a b a">x<li>y</ul><p>one<p>two<div id=d><bdi>i<bdi>j</bdi></bdi></div>&amp;<br/></b>')
    assert [n.text() for n in page.select("li")] == ["x", "y"] and [n.text() for n in page.select("p")] == ["one", "two"]
    assert page.first("li.a.b") is not None and page.first("#d bdi bdi").text() == "j" and page.first("ul p") is None
    assert dom.parse(None).text() == "" and dom.parse("&amp;x").text() == "&x"


def test_listing_and_profile():
    rows = pages.listing_rows(LISTING_PAGE, "https://d")
    assert [r["name"] for r in rows] == ["Ada L", "Bob"] and rows[0]["rank"] == "3.5" and rows[1]["rank"] is None
    found = pages.profile_of(PROFILE_PAGE)
    assert found["score"] == 4 and found["skills"] == ["sql", "unix"] and dict(found["stats"])["completion_rate"] == "100.00%"
    assert pages.profile_of(None)["status"] == "no_html" and pages.profile_of("<p>CloudFlare")["status"] == "blocked"
    table = "<table>" + "".join(f"<tr><td>{k}</td><td>1</td></tr>" for k in list(pages.LABELS)[:3]) + "</table>"
    assert len(pages.stats_of(dom.parse("<table><tr><td>x</table>" + table))) == 3


def test_table_function(spark):
    pages.register(spark)
    spark.createDataFrame([(LISTING_PAGE,)], "html string").createOrReplaceTempView("stored_pages")
    assert spark.sql("SELECT name FROM stored_pages, LATERAL listing_rows(html)").count() == 2


# ---------------------------------------------------------------- files, chains, engine

def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    assert files.read_jsonl(spark, path, LISTING).count() == 0
    rows = spark.createDataFrame([("a", "u", None, 'q"\n,', ""), ("b", "v", "x", None, "1")], LISTING)
    files.write_jsonl(rows, path)
    assert sorted(map(str, files.read_jsonl(spark, path, LISTING).collect())) == sorted(map(str, rows.collect()))
    assert files.write_csv(rows.limit(0), f"{path}-none") is False and not files.exists(spark, f"{path}-none")
    (tmp_path / "o.json").write_text('{"meta": 1, "users": [{"name": "a"}, {"name": "b"}]}')
    assert [r.name for r in files.read_any_json(spark, f"file://{tmp_path}/o.json", LISTING).collect()] == ["a", "b"]
    (tmp_path / "a.json").write_text('[{"name": "x"},\n {"name": "y"}]')
    for read in (files.read_any_json, files.read_json):
        assert [r.name for r in read(spark, f"file://{tmp_path}/a.json", LISTING).collect()] == ["x", "y"]
    (tmp_path / "n.json").write_text('{"meta": {"a": [1]}, "n": 2}')
    assert files.read_any_json(spark, f"file://{tmp_path}/n.json", LISTING).count() == 0 == files.read_json(spark, f"file://{tmp_path}/none.json", LISTING).count()
    assert files.read_uploads(spark, f"file://{tmp_path}/n.json").first().sha256 == hashlib.sha256((tmp_path / "n.json").read_bytes()).hexdigest()
    files.export(rows, f"{path}-json", f"{path}-csv")
    assert files.read_jsonl(spark, f"{path}-json", LISTING).count() == files.read_csv(spark, f"{path}-csv", LISTING).count() == 2
    assert files.may_write(spark, f"{path}-json", True) and files.may_write(spark, f"{path}-new")
    with pytest.raises(FileExistsError):
        files.may_write(spark, f"{path}-json")
    assert files.discard(rows) == 2 and files.clean_up(spark, [path]) == [path] and files.clean_up(spark, [path]) == []


def test_timed_paths():
    now = datetime.datetime(2024, 3, 1, 4, 5, 6)
    assert files.timed_path("{today}/{NOW}-{Yesterday}-{x}.json", now) == "2024-03-01/20240301_040506-2024-02-29-{x}.json"


@pytest.mark.parametrize(("argv", "error"), [
    ("discovery --pipelined extract --limit 3 --pipelined fetch --pipelined parse", None), ("followup --pipelined extract", None), ("extract --pipelined discovery", "cannot stand"), ("fetch --pipelined parse --pipelined fetch", "more than once"),
    ("extract --pipelined parse", "does not take"), ("extract", "two stages"), ("extract --pipelined --pipelined parse", "empty"), ("x --pipelined parse", "no stage"), ("--limit --pipelined parse", "must come first"), ("fetch --limit x --pipelined parse", "invalid")])
def test_chains(argv, error):
    if error is None:
        assert len(stages.parse(argv.split())) >= 2
    else:
        with pytest.raises(stages.ChainError, match=error):
            stages.parse(argv.split())


def test_engine_end_to_end(spark):
    jobs = spark.createDataFrame([("development (base)", ("base", None, {}, None), 1)], "label string, combo struct<dim:string,value:string,params:map<string,string>,keyword:string>, last_page int")
    base = "https://directory.example/list?verified=false&specialities=development"
    stored = spark.createDataFrame([(base, LISTING_PAGE), ("https://directory.example/u/ada", PROFILE_PAGE), ("https://x.example/u/bob", None)], "url string, html string")
    engine = Engine(spark, pages_by_url(stored))
    rows = engine.run("chain", names=["extract", "fetch", "parse"], seed=jobs)
    assert [(r.name, r.missing) for r in rows.collect()] == [("Ada L", 1)]
    report = {(r.phase, r.metric): r.value for r in engine.report().collect()}
    assert report["extract", "rows"] == 2 and report["parse", "succeeded"] == 1
    assert [r.name for r in engine.run("sample", jobs=jobs, limit=1).collect()] == ["Ada L"]
    with pytest.raises(ValueError, match="no command"):
        engine.run("dance")
    fixed = engine.run("fixup", listing=spark.createDataFrame([("Ada", "https://directory.example/u/ada", None, None, None)], LISTING))
    assert fixed.first().title == "Engineer" and fixed.first().rank == "2.0"
