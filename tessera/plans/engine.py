"""The phases as transforms of tables, and the commands that run them.

Fetching live pages is no part of the engine: ``pages`` (url, html) is a table, or anything that a
caller's function makes of urls. Every phase gives a DataFrame; a chain composes them without writing
between, so that Spark plans it as one query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import combos as combo_functions
from ..operators import metrics, quality, records
from ..sources import files
from ..sources import pages as page_sources
from . import stages


@dataclass
class Config:
    """Where tables are, and the limits of the phases."""

    listing_path: str = "listing"
    cache_path: str = "page_cache"
    raw_path: str = "raw"
    profile_path: str = "profiles"
    base_url: str = page_sources.BASE + "/list"
    min_html: int = page_sources.MIN_HTML
    min_confidence: int = page_sources.MIN_CONFIDENCE
    followup_pages: int = 10


def pages_by_url(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fetch from a table of stored pages (url, html)."""
    def fetch(urls: DataFrame) -> DataFrame:
        stored = pages.select(F.col("url").alias("_url"), "html")
        return urls.join(stored, F.col("url") == F.col("_url"), "left").drop("_url")

    return fetch


class Engine:
    def __init__(self, spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], config: Config | None = None, dims: dict | None = None):
        self.spark, self.fetch, self.config, self.dims = spark, fetch, config or Config(), dims
        self.reports: dict[str, Observation] = {}

    def _combos(self) -> DataFrame:
        rows = combo_functions.combinations(self.spark, self.dims)
        combo = F.struct("dim", "value", "params", "keyword")
        return rows.select("seq", combo_functions.label(F.col("dim"), F.col("value")).alias("label"), combo.alias("combo"))

    def _url(self, page) -> F.Column:
        return combo_functions.listing_url(self.config.base_url, F.col("dim"), F.col("value"), F.col("word"), page)

    @staticmethod
    def _flat(jobs: DataFrame, *columns: str) -> DataFrame:
        """The parts of combinations as columns, before anything is generated from their rows."""
        c = F.col("combo")
        return jobs.select(*columns, c.dim.alias("dim"), c.value.alias("value"), c.keyword.alias("word"))

    def observed(self, name: str, rows: DataFrame, *counts) -> DataFrame:
        """Counts of a phase, read from ``reports`` after its rows have been used."""
        self.reports[name] = Observation(name)
        return rows.observe(self.reports[name], F.count(F.lit(1)).alias("rows"), *counts)

    # ------------------------------------------------------------ phases

    def discovery(self, stored: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        """Page counts of combinations that the cache does not have, from stored pages (label, page, html)."""
        combos = self._combos()
        todo = combos if cache is None else records.remaining(combos, cache, "label")
        empty = F.coalesce(~F.contains("html", F.lit("freelancer-row")), F.lit(True))
        found = records.last_pages(stored, "label", "page", empty)
        joined = todo.join(found, "label", "left").select("label", "combo", F.coalesce("last_page", F.lit(0)).alias("last_page"))
        return self.observed("discovery", joined, F.count_if(F.col("last_page") > 0).alias("with_pages"), F.sum("last_page").alias("pages"))

    def followup(self, listing: DataFrame) -> DataFrame:
        return self.observed("followup", records.keywords(listing))

    def extract(self, jobs: DataFrame, suppress: DataFrame | None = None, existing: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """Unique listing rows of page counts or of keywords (those end at their first empty page)."""
        if "keyword" in jobs.columns:
            most = self.config.followup_pages
            numbered = self._flat(jobs, "keyword").withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(most))))
            fetched = self.fetch(numbered.select("keyword", "page", self._url(F.col("page")).alias("url")))
            empty = F.coalesce(~F.contains("html", F.lit("freelancer-row")), F.lit(True))
            fetched = records.until_empty(fetched, "keyword", "page", empty, most)
        else:
            numbered = records.pages_of(self._flat(jobs.where("last_page > 0"), "label", "last_page"), "last_page")
            fetched = self.fetch(numbered.select("label", "page", self._url(F.col("page")).alias("url")))
        rows = page_sources.listings(fetched.where("html IS NOT NULL"), "url", "html").withColumn("_order", F.struct("url", "seq")).drop("url", "seq")
        if suppress is not None:
            rows, _ = records.suppressed(rows, suppress, "profile_url")
        rows = records.first_per_key(rows, "profile_url", "_order")
        if existing is not None:
            rows = records.remaining(rows, existing, "profile_url")
            rows = existing.select(*[c for c in rows.columns if c != "_order"]).unionByName(rows.drop("_order"))
        else:
            rows = rows.drop("_order")
        if limit is not None:
            rows = records.limited(rows, limit, False, "profile_url")
        return self.observed("extract", rows, F.count("title").alias("with_title"))

    def fetch_pages(self, listing: DataFrame, fetched: DataFrame | None = None, limit: int | None = None, seeded: bool = True) -> DataFrame:
        urls = listing.select("profile_url").distinct()
        if seeded:
            urls = records.limited(urls, limit, True, "profile_url")
        if fetched is not None:
            urls = records.remaining_fetches(urls, fetched)
        if not seeded:
            urls = records.limited(urls, limit, False, "profile_url")
        own = self.fetch(urls.withColumn("url", F.col("profile_url"))).drop("url")
        other = self.fetch(own.withColumn("url", F.concat("profile_url", F.lit("/portfolio"))).withColumnRenamed("html", "own")).withColumnRenamed("html", "portfolio_html")
        rows = other.select("profile_url", F.col("own").alias("html"), "portfolio_html")
        return self.observed("fetch", rows, F.count("html").alias("fetched"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))

    def parse(self, raw: DataFrame, confidence: int | None = None, seq: str | None = None) -> DataFrame:
        """Profiles of raw pages. Of several pages of a profile the last by ``seq`` counts; without one, the longest (the greatest of those)."""
        order = F.col(seq) if seq else F.struct(F.length("html"), "html", F.length("portfolio_html"), "portfolio_html")
        last = records.last_per_key(raw.select("profile_url", "html", "portfolio_html", order.alias("_n")), "profile_url", "_n").drop("_n", "position")
        rows = page_sources.profiles(last, self.config.min_html, self.config.min_confidence if confidence is None else confidence)
        rows = quality.missing_fields(rows)
        return self.observed("parse", rows, F.count_if(F.col("name") != "Unknown").alias("succeeded"), F.sum("missing").alias("missing"))

    def fixup(self, listing: DataFrame) -> DataFrame:
        bad = records.needs_fixup(listing)
        raw = self.fetch(bad.select("profile_url", F.col("profile_url").alias("url"))).select("profile_url", "html", F.lit(None).cast("string").alias("portfolio_html"))
        return self.observed("fixup", records.fix_up(listing, page_sources.profiles(raw, self.config.min_html, self.config.min_confidence)))

    # ------------------------------------------------------------ commands

    def run(self, command: str, **options) -> DataFrame | dict | list:
        """One command: a phase by name, ``deep_scrape`` (fetch and parse), ``chain``, ``sample``, ``stats`` or ``cleanup``."""
        actions = {
            "discovery": self.discovery, "followup": self.followup, "extract": self.extract, "fetch": self.fetch_pages, "parse": self.parse, "fixup": self.fixup, "deep_scrape": self.deep_scrape,
            "chain": self.chain, "sample": self.sample, "stats": self.stats, "cleanup": self.cleanup}
        if command not in actions:
            raise ValueError(f"no command {command!r}; there are: {', '.join(sorted(actions))}")
        return actions[command](**options)

    def deep_scrape(self, listing: DataFrame, **options) -> DataFrame:
        return self.parse(self.fetch_pages(listing, **options))

    def sample(self, jobs: DataFrame, limit: int = 2) -> DataFrame:
        return self.extract(jobs.limit(1)).limit(limit)

    def chain(self, names: list[str] | list[tuple[str, dict]], seed: DataFrame, **options) -> DataFrame:
        """Stages one after the other on a seed, always validated first."""
        steps = stages.steps([n if isinstance(n, tuple) else (n, {}) for n in names])
        actions = {"discovery": self.discovery, "followup": self.followup, "extract": self.extract, "fetch": self.fetch_pages, "parse": self.parse, "fixup": self.fixup}
        rows = seed
        for step in steps:
            action = actions[step.stage.name]
            rows = action(rows, **stages.bound(action, options | step.options))
        return rows

    def stats(self, profiles: DataFrame) -> dict:
        row = profiles.agg(F.sort_array(F.collect_set("category")).alias("categories"), F.count("*").alias("n")).first()
        return {"categories": row.categories, "total": row.n}

    def save(self, rows: DataFrame, path: str, overwrite: bool = False) -> None:
        """Write the rows of a phase; a path that is there is only replaced if that is asked for."""
        files.write_json(rows, path, "overwrite" if files.may_write(self.spark, path, overwrite) else "errorifexists")

    def cleanup(self, paths: list[str] | None = None) -> list[str]:
        """Delete the engine's own outputs."""
        c = self.config
        return files.clean_up(self.spark, paths or [c.listing_path, c.cache_path, c.raw_path, c.profile_path])

    def report(self) -> DataFrame:
        """Counts of the phases whose rows have been used, in long form."""
        rows = [(p, m, float(v or 0), m in ("rows", "bytes")) for p, o in self.reports.items() for m, v in o.get.items()]
        return metrics.in_order(self.spark.createDataFrame(rows, "phase string, metric string, value double, overlappable boolean"))
