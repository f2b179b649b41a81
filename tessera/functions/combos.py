"""Search combinations: one dimension at a time, with labels and addresses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMBO

#: Parameters that every address has, and the text of labels.
FIXED_PARAMS = (("verified", "false"), ("specialities", "development"))
RATINGS = ("1", "2", "3", "4", "5")
TITLES = (
    "researcher", "pharmacist", "writer", "translator", "data-analyst", "graphic-designer", "web-designer", "software-engineer", "computer-engineer", "electrical-engineer", "logo-designer",
    "web-developer", "digital-marketer", "virtual-assistant", "flutter-developer", "executive-director", "مصمم-ومدخل-بيانات", "مبرمج-و-مسوق", "تصميم-وكتابة", "محاسب-بنكي")
SKILLS = (
    "IOS", "accounting", "advertisement-design", "ajax", "angular-js", "animation", "asp-net", "broadcast-direction", "business-writing", "circuit-design", "concept-design",
    "content-writing", "creative-design", "csharp-programming", "data-entry", "data-warehousing", "database-programming", "dot-net", "electrical-engineering", "english-grammar",
    "english-spelling", "google-adwords", "graphic-design", "interior-design", "investment-research", "jquery", "landing-pages", "life-coaching", "market-research", "microsoft",
    "mysql", "phone-support", "photoshop", "powerpoint", "proposal-bid-writing", "psychology", "research", "search-engine-marketing", "slogans", "software-development", "sql",
    "startups", "sticker-design", "telemarketing", "templates", "test-automation", "time-management", "troubleshooting", "unix", "video-production", "website-design",
    "word-processing", "إنشاء-موقع-إلكتروني", "إنشاء-موقع-ووردبريس", "اسكتش-اب", "تعديل-الصوت")
COUNTRIES = (
    "jo", "bh", "dz", "sa", "sd", "so", "iq", "kw", "ma", "ye", "tn", "km", "dj", "sy", "om", "ps", "qa", "lb", "ly", "eg", "mr", "aw", "az", "am", "au", "ee", "af", "al", "de",
    "aq", "ag", "ad", "id", "ao", "ai", "uy", "uz", "ug", "qo", "ua", "ie", "is", "et", "es", "ir", "it", "ar", "io", "ec", "eu", "bs", "br", "pt", "ba", "ga", "me", "dk", "cv",
    "sv", "sn", "se", "cn", "va", "ph", "cm", "cg", "cd", "tf", "mx", "gb", "at", "ne", "in", "us", "jp", "gr", "pg", "py", "pk", "pw", "bw", "bb", "bm", "bn", "be", "bg", "bz",
    "bd", "pa", "bj", "bt", "pr", "bf", "bi", "pl", "bo", "pf", "pe", "tz", "th", "tw", "tm", "tr", "ta", "tt", "td", "tg", "tv", "tk", "to", "tl", "jm", "gi", "ax", "an", "tc",
    "ky", "ic", "mh", "mv", "um", "pn", "sb", "fo", "vi", "vg", "fk", "ck", "cc", "mp", "wf", "ac", "cx", "bv", "cp", "im", "nf", "hm", "cf", "cz", "do", "za", "gp", "ge", "gs",
    "je", "dm", "dg", "rw", "ru", "by", "ro", "re", "zm", "zw", "ci", "ws", "as", "bl", "sm", "pm", "vc", "kn", "lc", "mf", "sh", "st", "lk", "sj", "sk", "si", "sg", "sz", "sr",
    "ch", "sl", "sc", "sx", "ea", "cl", "rs", "tj", "gm", "gh", "gd", "gl", "gt", "gu", "gf", "gy", "gg", "gn", "gq", "gw", "vu", "fr", "il", "ve", "fi", "vn", "fj", "cy", "kg",
    "kz", "nc", "hr", "kh", "ca", "cu", "cw", "kr", "kp", "cr", "xk", "co", "ki", "ke", "lv", "la", "lu", "lr", "lt", "li", "ls", "mq", "mt", "ml", "my", "yt", "mg", "mk", "mo",
    "mw", "mn", "mu", "mz", "md", "mc", "ms", "mm", "fm", "na", "nr", "np", "ng", "ni", "nz", "nu", "ht", "hn", "hu", "nl", "bq", "hk")
BASE_LABEL, LABEL = "development (base)", "development+"


def combinations(spark: SparkSession, dims: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """The base and one row per value of each dimension (not their product), numbered in order.

    ``dims`` gives other values per dimension; ratings, titles, skills and country codes are there by
    default.
    """
    dims = {"rating": RATINGS, "titles": TITLES, "skills": SKILLS, "country": COUNTRIES} | (dims or {})
    rows = [("base", None, {}, None)] + [(d, v, {d: v}, None) for d, values in dims.items() for v in values]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, f"seq int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in COMBO)}")


def label(dim: Column, value: Column) -> Column:
    return F.when(dim == "base", BASE_LABEL).otherwise(F.concat(F.lit(LABEL), dim, F.lit("="), value))


def form_encode(s: Column) -> Column:
    """Form encoding as browsers' query strings have it: ~ stays, * is coded."""
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def listing_url(base: str, dim: Column, value: Column, keyword: Column, page: Column) -> Column:
    """Address of a combination's page; the page is left out if it is the first."""
    fixed = "&".join(f"{k}={v}" for k, v in FIXED_PARAMS)
    own = F.when((dim != "base") & value.isNotNull(), F.concat(form_encode(dim), F.lit("="), form_encode(value)))
    word = F.when(keyword.isNotNull(), F.concat(F.lit("keyword="), form_encode(keyword)))
    number = F.when(page > 1, F.concat(F.lit("page="), page.cast("string")))
    return F.concat_ws("&", F.lit(f"{base}?{fixed}"), own, word, number)
