"""Dedup, resume and suppression, upsert, generators: record sets by key.

"First" and "last" always follow an explicit order column; nothing relies on partition order. All
aggregates have partial sums, so a key with a third of the rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of every key."""
    return _picked(rows, key, F.min_by, seq)


def last_per_key(rows: DataFrame, key: str, seq: str, position: str = "position") -> DataFrame:
    """The last row of every key, with the place where the key first stood."""
    kept = _picked(rows, key, F.max_by, seq, F.min(seq).alias("_first"))
    return kept.withColumnRenamed("_first", position)


def _picked(rows: DataFrame, key: str, pick, seq: str, *more: Column) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in rows.columns])
    grouped = rows.groupBy(F.col(key).alias("_key")).agg(pick(whole, F.col(seq)).alias("_row"), *more)
    return grouped.select("_row.*", *[c for c in grouped.columns if c not in ("_key", "_row")])


def distinct_first_words(rows: DataFrame, name: str) -> DataFrame:
    from ..functions.text import first_word

    return rows.select(first_word(F.col(name)).alias("keyword")).where("keyword IS NOT NULL").distinct()


def keywords(rows: DataFrame, name: str = "name") -> DataFrame:
    """Keyword items of the distinct first words of names, in order."""
    combo = F.struct(F.lit("base").alias("dim"), F.lit(None).cast("string").alias("value"), F.create_map().cast("map<string,string>").alias("params"), F.col("keyword"))
    return distinct_first_words(rows, name).orderBy("keyword").select("keyword", combo.alias("combo"))


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: rows whose key is not done."""
    return wanted.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def remaining_fetches(urls: DataFrame, fetched: DataFrame) -> DataFrame:
    """Resume fetching: a page counts as fetched only if it has html."""
    return remaining(urls, fetched.where("html IS NOT NULL"), "profile_url")


def suppressed(new: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New rows whose key is not known, and the count of the others."""
    known = known.select(F.col(key).alias("_known"))
    same = F.col(key) == F.col("_known")
    return new.join(known, same, "left_anti"), new.join(known, same, "left_semi").agg(F.count("*").alias("suppressed"))


def cached_jobs(cache: DataFrame, combos: DataFrame) -> DataFrame:
    """Combinations with their cached page counts; empty ones and unknown labels are left out."""
    return cache.join(combos, "label").where("last_page > 0")


def pages_of(jobs: DataFrame, last: str, page: str = "page") -> DataFrame:
    """One row per page 1..last."""
    return jobs.where(F.col(last) >= 1).withColumn(page, F.explode(F.sequence(F.lit(1), F.col(last))))


def union_first(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Existing rows come first, then new ones; the first of a key stays."""
    both = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both.withColumn("_order", F.struct("_part", seq)), key, "_order").drop("_order", "_part")


def needs_fixup(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(title, '') = '' OR rank IS NULL")


def fix_up(rows: DataFrame, parsed: DataFrame, seq: str | None = None) -> DataFrame:
    """Repaired titles (new or old) and ranks (the rating, where one was read); all rows are kept.

    Of several repairs of a row the first by ``seq`` counts; without one, the least of their values.
    """
    order = F.col(seq) if seq else F.struct("title", "rating")
    new = first_per_key(parsed.select("profile_url", "title", "rating", order.alias("_n")), "profile_url", "_n").select(
        F.col("profile_url").alias("_url"), F.col("title").alias("_title"), F.col("rating").alias("_rating"))
    joined = rows.join(new, F.col("profile_url") == F.col("_url"), "left")
    title = F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("title"))
    return joined.withColumn("title", title).withColumn("rank", F.coalesce(F.col("_rating").cast("string"), F.col("rank"))).drop("_url", "_title", "_rating")


def with_portfolio(profiles: DataFrame, pages: DataFrame) -> DataFrame:
    """Profile pages with the html of their portfolio pages (url, html)."""
    other = pages.select(F.col("url").alias("_url"), F.col("html").alias("portfolio_html"))
    return profiles.join(other, F.concat("profile_url", F.lit("/portfolio")) == F.col("_url"), "left").drop("_url")


def limited(rows: DataFrame, limit: int | None, seeded: bool, order: str) -> DataFrame:
    """The url cap: a seeded run takes 0 as no limit, a streamed one as nothing."""
    if limit is None or (seeded and limit == 0):
        return rows
    return rows.orderBy(order).limit(limit)


def until_empty(pages: DataFrame, group: str, page: str, empty: Column, most: int) -> DataFrame:
    """Pages of a group before its first empty one, at most ``most`` of them."""
    gaps = pages.where(F.col(page) <= most).groupBy(F.col(group).alias("_group")).agg(F.min(F.when(empty, F.col(page))).alias("_gap"))
    near = pages.where(F.col(page) <= most)
    return near.join(gaps, F.col(group).eqNullSafe(F.col("_group"))).where((F.col("_gap").isNull()) | (F.col(page) < F.col("_gap"))).drop("_group", "_gap")


def last_pages(pages: DataFrame, group: str, page: str, empty: Column) -> DataFrame:
    """Largest page that is not empty, 0 if there is none."""
    return pages.groupBy(group).agg(F.coalesce(F.max(F.when(~empty, F.col(page))), F.lit(0)).cast("int").alias("last_page"))


def discover(exists, start: int = 100, most: int = 10_000) -> int:
    """Probe for the last page: double while pages exist (not past ``most``), then bisect. ``exists(page)`` asks."""
    if not exists(1):
        return 0
    low, high = 1, start
    while exists(high):
        low, high = high, high * 2
        if high > most:
            break
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low


def page_stats(cache: DataFrame) -> DataFrame:
    """Totals over page counts; the least is of those that are set."""
    last = F.col("last_page")
    return cache.agg(F.max(last).alias("most"), F.min(F.nullif(last, F.lit(0))).alias("least"), F.sum(last).cast("long").alias("pages"), F.count_if(last == 0).alias("empty"))


def recent(rows: DataFrame, n: int, order: str, group: str | None = None, tie: str | None = None) -> DataFrame:
    """The n latest rows (of each group); a task sends at most n rows of a group on."""
    columns = [F.desc(order), *([F.desc(tie)] if tie else [])]
    if group is None:
        return rows.orderBy(*columns).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*columns))).where(F.col("_n") <= n).drop("_n")


def by_priority(sources: list[DataFrame], key: str, current: Column | None = None, modified: str | None = None) -> DataFrame:
    """Union of sources; a key is taken from the first that has it.

    With ``modified``, the result files are listed as the commands show them: the current one first, then
    the latest ones.
    """
    whole = None
    for i, s in enumerate(sources):
        part = s.withColumn("priority", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    # Rows of one source that share a key are told apart by their values.
    kept = first_per_key(whole.withColumn("_order", F.struct("priority", *[c for c in whole.columns if c not in (key, "priority")])), key, "_order").drop("_order")
    if modified is None:
        return kept
    kept = kept.withColumn("is_current", F.coalesce(current if current is not None else F.lit(False), F.lit(False)))
    return kept.orderBy(F.desc("is_current"), F.desc(modified), key)


def paged(rows: DataFrame, page: int, size: int, *order) -> DataFrame:
    """A page of rows (from 0) under a total order."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def compared(stored: DataFrame, parsed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Null-safe differences by key: (key, field, kind, stored, parsed)."""
    left = stored.select(F.col(key).alias("_l"), *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    right = parsed.select(F.col(key).alias("_r"), *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    joined = left.join(right, F.col("_l") == F.col("_r"), "full")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("stored"), F.col(f"r_{f}").alias("parsed")) for f in fields])
    kind = F.when(F.col("_l").isNull(), "only_parsed").when(F.col("_r").isNull(), "only_stored").when(F.col("c.stored").isNull(), "filled").when(F.col("c.parsed").isNull(), "lost").otherwise("changed")
    rows = joined.select("_l", "_r", F.explode(cells).alias("c")).where(~F.col("c.stored").eqNullSafe(F.col("c.parsed")))
    return rows.select(F.coalesce("_l", "_r").alias(key), "c.field", kind.alias("kind"), "c.stored", "c.parsed")
