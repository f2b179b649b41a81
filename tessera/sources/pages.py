"""Listing and profile pages as records: map over pages, only the html and its key go to Python."""

from __future__ import annotations

import datetime
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LISTING
from . import dom

BASE = "https://directory.example"
MIN_HTML = 20_000
MIN_CONFIDENCE = 2
#: Labels of the statistics table and their fields; names of confidence signals; selectors of names, titles, skills and landmarks.
LABELS = {
    "معدل التوظيف": "employment_rate", "المشاريع المستلمة": "received_projects", "تعاملاتي معه": "financial_deals", "إكمال المشاريع": "completion_rate", "التسليم بالموعد": "ontime_delivery_rate",
    "إعادة التوظيف": "rehire_rate", "نجاح التواصلات": "communication_success_rate", "نجاح التواصل": "communication_success_rate", "المشاريع المكتملة": "total_completed_projects",
    "متوسط سرعة الرد": "avg_response_time_raw", "تاريخ التسجيل": "registration_date_raw", "آخر تواجد": "last_active_raw", "مشاريع يعمل عليها": "active_projects"}
SIGNALS = ("html_size", "has_h1", "has_stats_table", "has_skills", "has_profile_name")
NAME = ("h1.profile-name bdi", "h1 bdi", "h1.usercard__username bdi")
TITLE = ("li.profile-title a", "li.profile-title")
SKILLS = ("ul.skills li.skills__item a bdi", ".skills__item bdi", ".tag bdi")
LANDMARKS = (
    "h1", "h1 bdi", "h1.profile-name", "#user-stats", "#profile-stats", "table.table-meta", "ul.skills", ".skills__item", ".tag", "li.profile-title", "li.profile-country", ".rating-stars", "div.postcard.cell-container")


def plain_label(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[إأآ]", "ا", text).replace("ـ", "")).strip()


_FIELD = {plain_label(k): v for k, v in LABELS.items()}


def stars(node: dom.Node | None) -> float | None:
    """Full stars and half ones; null without the element."""
    if node is None:
        return None
    return sum(1 for _ in node.select("i.fa-star")) + 0.5 * sum(1 for _ in node.select("i.fa-star-half-o"))


def listing_rows(html: str | None, base: str = BASE) -> list[dict]:
    """Records of a directory page; a row without a link has none."""
    out = []
    for row in dom.parse(html).select("tr.freelancer-row"):
        link = row.first("td.details-td a[href]", "td.info-td a[href]")
        if link is None:
            continue
        href = link.attrs["href"].strip()
        icon = row.first("i.fa-briefcase")
        title = icon.parent.text() if icon is not None else ""
        if not title and (plain := row.first("p.freelancer-title")) is not None:
            title = plain.text()
        image, rating = row.first("td.info-td img[src]"), stars(row.first(".freelancers__item-rating"))
        out.append({"name": (link.first("bdi") or link).text(), "profile_url": href if href.startswith("http") else base + href, "avatar_url": image.attrs["src"] if image is not None else None,
                    "title": title or None, "rank": None if rating is None else str(float(rating))})
    return out


def _cells(table: dom.Node, selector: str):
    for row in table.select(selector):
        cells = [n for n in row.walk() if n.tag == "td"]
        if cells:
            yield cells


def stats_panel(page: dom.Node) -> dom.Node | None:
    """The statistics panel, else the first table with three known labels."""
    panel = page.first("#user-stats")
    if panel is not None:
        return panel
    for table in page.select("table"):
        if sum(plain_label(cells[0].text()) in _FIELD for cells in _cells(table, "tr")) >= 3:
            holder = dom.Node("div", {}, None)
            holder.children.append(table)
            return holder
    return None


def stats_of(page: dom.Node) -> dict[str, str]:
    panel, out = stats_panel(page), {}
    if panel is not None:
        for table in panel.select("table"):
            for cells in _cells(table, "tr"):
                if len(cells) >= 2 and (field := _FIELD.get(plain_label((cells[0].first("span") or cells[0]).text()))):
                    out[field] = cells[1].text(" ")
    return out


def signals_of(html: str | None, page: dom.Node, least: int = MIN_HTML) -> tuple[int, list[str], str]:
    """Score, signals and status (ok, no_html or blocked) of a page."""
    if not html:
        return 0, [], "no_html"
    if re.search(r"""id=["']?captcha-container""", html) or "cloudflare" in html.lower():
        return 0, [], "blocked"
    head = page.first("h1")
    there = (len(html) >= least, head is not None, page.first("table.table-meta") is not None, page.first(".skills__item") is not None,
             page.first(".profile-name") is not None or (head is not None and head.first("bdi") is not None))
    found = [s for s, ok in zip(SIGNALS, there, strict=True) if ok]
    return len(found), found, "ok"


def profile_of(html: str | None, portfolio: str | None = None, least: int = MIN_HTML) -> dict:
    """Everything a profile page tells; fields are null where it does not."""
    page = dom.parse(html)
    score, signals, status = signals_of(html, page, least)
    text = lambda node: node.text() if node is not None else None
    title = text(page.first(*TITLE))
    skills = next((found for s in SKILLS if (found := [t for n in page.select(s) if (t := n.text())])), [])
    stats = stats_of(page)
    cards = dom.parse(portfolio) if portfolio else page
    return {
        "score": score, "signals": signals, "status": status, "name": text(page.first(*NAME)), "title": None if title is None else re.sub(r"^[^\w؀-ۿ]+", "", title).strip(),
        "location": text(page.first("li.profile-country")), "rating": stars(page.first(".rating-stars")), "skills": skills, "portfolio_count": sum(1 for _ in cards.select("div.postcard.cell-container")), "stats": list(stats.items())}


def labels_of(html: str | None) -> dict[str, str]:
    """Labels of all statistics tables with their values."""
    page, out = dom.parse(html), {}
    for selector in ("#user-stats table", "#profile-stats table", "table.table-meta"):
        for table in page.select(selector):
            for cells in _cells(table, "tr"):
                if len(cells) >= 2:
                    out[plain_label((cells[0].first("span") or cells[0]).text())] = cells[1].text(" ")
    return out


def landmarks_of(html: str | None) -> list[tuple[str, int, str | None]]:
    """(selector, hits, sample of the first)."""
    page, out = dom.parse(html), []
    for s in LANDMARKS:
        hits = list(page.select(s))
        out.append((s, len(hits), hits[0].text(" ")[:80] if hits else None))
    return out


def _generated(pages: DataFrame, key: str, fields: str, rows_of) -> DataFrame:
    """One to many rows per page: (key, fields)."""
    ddl = f"`{key}` {dict(pages.dtypes)[key]}, {fields}"
    names = re.findall(r"(\w+) [\w<>:,]+(?:, |$)", fields)

    def run(batches):
        for batch in batches:
            keys, values = [], {n: [] for n in names}
            for k, *inputs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in rows_of(*inputs):
                    keys.append(k)
                    for n in names:
                        values[n].append(row[n])
            yield pa.RecordBatch.from_pydict({key: pa.array(keys, batch.schema.types[0]), **values}, schema=pa.schema([(key, batch.schema.types[0]), *_types(fields, names)]))

    return pages.mapInArrow(run, ddl)


def _types(fields: str, names: list[str]):
    known = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    kinds = re.findall(r"\w+ ([\w<>:,]+)(?:, |$)", fields)
    return [(n, known[k]) for n, k in zip(names, kinds, strict=True)]


def listings(pages: DataFrame, key: str = "url", html: str = "html", base: str = BASE) -> DataFrame:
    """T1: (key, seq, listing fields) of every row of every directory page; seq is the place on the page."""
    def rows(text):
        return [r | {"seq": i} for i, r in enumerate(listing_rows(text, base))]

    fields = "seq int, " + ", ".join(f"{f.name} string" for f in LISTING)
    return _generated(pages.select(key, html), key, fields, rows)


PROFILE_FIELDS = "score int, signals array<string>, status string, name string, title string, location string, rating double, skills array<string>, portfolio_count int, stats map<string,string>"


def profiles(raw: DataFrame, least: int = MIN_HTML, confidence: int = MIN_CONFIDENCE, category: str = "development", now: Column | None = None) -> DataFrame:
    """T2: profile records of raw pages (profile_url, html, portfolio_html) that are trusted enough."""
    found = _generated(raw.select("profile_url", "html", "portfolio_html"), "profile_url", PROFILE_FIELDS, lambda h, p: [profile_of(h, p, least)])
    stat = lambda name: F.try_element_at("stats", F.lit(name))
    return found.where(F.col("score") >= confidence).select(
        F.coalesce("name", F.lit("Unknown")).alias("name"), "profile_url", F.lit(category).alias("category"), "title", "location", "rating", F.lit(0).alias("reviews_count"), stat("completion_rate").alias("completion_rate"),
        stat("rehire_rate").alias("rehire_rate"), stat("avg_response_time_raw").alias("response_time"), stat("last_active_raw").alias("last_seen"), stat("registration_date_raw").alias("member_since"),
        "status", F.get("signals", F.lit(0)).alias("parse_confidence"), "score", "signals", "skills", "portfolio_count", "stats", (now if now is not None else F.lit(datetime.datetime.now())).cast("timestamp").alias("scraped_at"))


def page_labels(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    return _generated(pages.select(key, html), key, "label string, value string", lambda h: [{"label": k, "value": v} for k, v in labels_of(h).items()])


def landmarks(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    return _generated(pages.select(key, html), key, "selector string, hits int, sample string", lambda h: [{"selector": s, "hits": n, "sample": t} for s, n, t in landmarks_of(h)])


def register(spark) -> None:
    """The listing generator as a SQL table function: SELECT * FROM t, LATERAL listing_rows(t.html)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=LISTING.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    class ListingRows:
        def eval(self, html: str):
            for r in listing_rows(html):
                yield tuple(r[f.name] for f in LISTING)

    spark.udtf.register("listing_rows", ListingRows)
