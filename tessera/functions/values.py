"""Typed values out of text: numbers, money, Arabic durations and dates, lists in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, normalize_label, trimmed

#: Fixed values.
EASTERN_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
MONTHS = {
    "يناير": 1, "جانفي": 1, "فبراير": 2, "فيفري": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "مايو": 5, "ماي": 5, "يونيو": 6, "يونيه": 6, "يوليو": 7,
    "يوليه": 7, "أغسطس": 8, "اغسطس": 8, "أغسطص": 8, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12}
UNIT_MINUTES = {
    "دقيقة": 1, "دقيقتين": 2, "دقائق": 1, "ساعة": 60, "ساعتين": 120, "ساعات": 60, "يوم": 1440, "يومين": 2880, "أيام": 1440, "أسبوع": 10080, "أسبوعين": 20160}
NUMBER_WORDS = {
    "صفر": 0, "واحد": 1, "اثنين": 2, "ثلاثة": 3, "أربعة": 4, "خمسة": 5, "ستة": 6, "سبعة": 7, "ثمانية": 8, "تسعة": 9, "عشرة": 10, "عشرين": 20, "ثلاثين": 30, "أربعين": 40, "خمسين": 50}
LESS_THAN, AND = "أقل من", "و"
#: Day-first formats that are read as they are; a list, as a free-form date reader has no equal here.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d, yyyy")


def _lookup(table: dict, key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def western(s: Column) -> Column:
    return F.translate(s, EASTERN_DIGITS, WESTERN_DIGITS)


def decimal_of(s: Column) -> Column:
    """Digits and points of a text as a double (percent, money); 0 if they are no number."""
    return F.coalesce(F.regexp_replace(western(s), "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def integer_of(s: Column) -> Column:
    """Digits of a text as a long, else 0."""
    return F.coalesce(F.regexp_replace(western(s), "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def minutes_of(s: Column) -> Column:
    """Arabic duration in minutes; a number counts for the unit right after it, a unit alone counts once."""
    tokens = F.split(trimmed(F.regexp_replace(trimmed(s), f"(?U)\\s+{AND}\\s+", " ")), BLANK)

    def step(state: Column, token: Column) -> Column:
        unit = _lookup(UNIT_MINUTES, token)
        digits = F.regexp_replace(token, f"[^0-9{EASTERN_DIGITS}]", "")
        number = F.coalesce(_lookup(NUMBER_WORDS, token).cast("long"), western(digits).try_cast("long"))
        total = F.when(unit.isNotNull(), state.total + F.coalesce(state.number, F.lit(1).cast("long")) * unit).otherwise(state.total)
        return F.struct(total.cast("long").alias("total"), F.when(unit.isNull(), number).alias("number"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("number"))
    folded = F.aggregate(tokens, start, step, lambda state: state.total)
    return F.when(F.coalesce(trimmed(s), F.lit("")) == "", F.lit(0).cast("long")).when(F.contains(s, F.lit(LESS_THAN)), F.lit(1).cast("long")).otherwise(folded)


def date_of(s: Column) -> Column:
    """A listed format, else Arabic "day month year", else 1 January of a year 20xx, else null."""
    raw = western(trimmed(s))
    listed = [F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in DATE_FORMATS]
    plain = F.regexp_replace(normalize_label(raw), "^[^0-9]+", "")
    found = "([0-9]{1,2})\\s+([^0-9\\s]+)\\s+([0-9]{4})"
    part = [F.regexp_extract(plain, found, k) for k in (1, 2, 3)]
    names = {}
    for name, number in MONTHS.items():
        for alef in "إأآ":
            name = name.replace(alef, "ا")
        names[name] = number
    arabic = F.try_make_timestamp(part[2].try_cast("int"), _lookup(names, part[1]), part[0].try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    year = F.make_date(F.regexp_extract(raw, "\\b(20[0-9]{2})\\b", 1).try_cast("int"), F.lit(1), F.lit(1))
    return F.coalesce(*listed, arabic, year)


def number_or_zero(c: Column) -> Column:
    """As a double; bad, missing and NaN values are 0."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def list_of(c: Column) -> Column:
    """A JSON list in text (starting with ``[``) as an array, else an empty one."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")), empty)
