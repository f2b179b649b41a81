"""Text expressions: Arabic-aware normalisation, names, links, markup, formats. All run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that normalisation unifies or drops.
ALEFS_A, TATWEEL = "إأآ", "ـ"
ALEFS_B, MAKSURA, MARBUTA = "آأإٱ", "ى", "ة"
ALEF, YA, HA = "ا", "ي", "ه"
DIACRITICS = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640]"
BLANK = "(?U)\\s+"


def trimmed(s: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(s, "(?U)^\\s+|\\s+$", "")


def one_spaced(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, BLANK, " "))


def normalize_label(s: Column) -> Column:
    """Alef variants become alef, tatweel goes, runs of white space become one space."""
    return one_spaced(F.translate(s, ALEFS_A + TATWEEL, ALEF * len(ALEFS_A)))


def normalize_search(s: Column) -> Column:
    """For search: no diacritics or tatweel, unified alef, ya and ha, lower case.

    Text is taken as NFC already; ``nfc`` makes it so where it may not be.
    """
    bare = F.regexp_replace(s, DIACRITICS, "")
    return F.lower(F.translate(bare, ALEFS_B + MAKSURA + MARBUTA, ALEF * len(ALEFS_B) + YA + HA))


def _to_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(s: Column) -> Column:
    """Unicode NFC. Text of Basic Latin and precomposed letters only skips the Python step."""
    return F.when(s.rlike("^[\\u0000-\\u02FF]*$"), s).otherwise(F.pandas_udf(_to_nfc, "string")(s))


def first_word(s: Column) -> Column:
    """First word; null for blank names."""
    return F.nullif(F.get(F.split(trimmed(s), BLANK), F.lit(0)), F.lit(""))


def strip_lead(s: Column) -> Column:
    """Without leading characters that are neither of a word nor Arabic."""
    return trimmed(F.regexp_replace(s, "(?U)^[^\\w\\u0600-\\u06FF]+", ""))


def absolute_url(href: Column, base: str) -> Column:
    href = trimmed(href)
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def slug(url: Column) -> Column:
    """Last path segment."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def initials(name: Column) -> Column:
    """First letters of the first and last word, or of the only word; ``?`` for none."""
    words = F.filter(F.split(trimmed(F.coalesce(name, F.lit(""))), BLANK), lambda w: w != "")
    head, tail = F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.element_at(words, -1), 1, 1)
    return F.when(F.size(words) == 0, "?").when(F.size(words) == 1, F.upper(head)).otherwise(F.upper(F.concat(head, tail)))


def avatar_url(url: Column) -> Column:
    """Scheme-relative addresses become https; blank ones null."""
    u = trimmed(url)
    return F.when(u == "", None).when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)


def escape_html(s: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(plain), F.lit(coded))
    return s


def minutes_seconds(seconds: Column) -> Column:
    """``mm:ss``, with as many digits as the minutes take."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("string")
    # lpad cuts what is longer than its length.
    return F.concat(F.lpad(minutes, F.greatest(F.length(minutes), F.lit(2)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def one_decimal(x: Column) -> Column:
    """One decimal, ties to even."""
    return F.format_string("%.1f", F.bround(x, 1))


def kilobytes(n: Column) -> Column:
    return F.concat(one_decimal(n / 1024), F.lit(" KB"))


def progress_credit(page: Column, last_page: Column, estimate: int = 20) -> Column:
    """Share of pages done, or 1 - 1 / (1 + page / estimate) where the last page is unknown."""
    return F.when(last_page > 0, page / last_page).otherwise(1 - 1 / (1 + page / F.lit(estimate)))


def penalty_seconds(attempt: Column, jitter: Column, start: float = 30.0, most: float = 120.0) -> Column:
    """Cooldown after the n-th refusal in a row: doubling, jittered, capped."""
    return F.least(F.lit(start) * F.pow(F.lit(2.0), attempt - 1) * jitter, F.lit(most))
