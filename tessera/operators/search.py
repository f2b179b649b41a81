"""Ranked name search: literal hits, fuzzy subsequences, highlights."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Affixes that a highlight takes in.
PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ف", "ب", "ك", "ل")
SUFFIXES = ("ها", "هم", "هن", "كم", "كن", "ية", "ات", "ون", "ين", "ان", "ه")
DROPPED = {*range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE), 0x0640}
UNIFIED = {0x0622: "ا", 0x0623: "ا", 0x0625: "ا", 0x0671: "ا", 0x0649: "ي", 0x0629: "ه"}


def literal_score(norm: Column, query: str) -> Column:
    """1000 less the place of the first hit; null without one."""
    at = F.instr(norm, query)
    return F.when(at > 0, 1000 - (at - 1))


def fuzzy_score(norm: Column, query: str) -> Column:
    """Greedy subsequence: 10 per character less the gaps between first and last hit; null if it does not fit."""
    n = len(query)
    wanted = F.array(*[F.lit(c) for c in query])

    def step(state: Column, c: Column) -> Column:
        done = state.found >= n
        hit = ~done & (c == F.get(wanted, state.found))
        gap = ~done & ~hit & (state.found > 0)
        return F.struct((state.found + F.when(hit, 1).otherwise(0)).alias("found"), (state.gaps + F.when(gap, 1).otherwise(0)).alias("gaps"))

    start = F.struct(F.lit(0).alias("found"), F.lit(0).alias("gaps"))
    return F.aggregate(F.split(norm, ""), start, step, lambda s: F.when(s.found == n, 10 * n - s.gaps))


def search(rows: DataFrame, query: str, norm: str = "norm", order: str = "pos", exact: bool = False) -> DataFrame:
    """Rows that match with their score, best first; a blank query keeps all rows in their order."""
    from ..functions.text import normalize_search

    asked = query.strip()
    if not asked:
        return rows.withColumn("score", F.lit(0)).orderBy(order)
    wanted = rows.sparkSession.range(1).select(normalize_search(F.lit(unicodedata.normalize("NFC", asked))).alias("q")).first().q
    score = literal_score(F.col(norm), wanted)
    if not exact:
        # Only names that hold the query's first character can match; the fold runs on those.
        fuzzy = F.when(F.contains(norm, F.lit(wanted[:1])), fuzzy_score(F.col(norm), wanted)) if wanted else F.lit(0)
        score = F.coalesce(score, fuzzy)
    return rows.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), order)


def with_index(name: str) -> tuple[str, list[int]]:
    """Normalised text and, for each of its characters, the place in the text it came from."""
    out, places = [], []
    for i, c in enumerate(unicodedata.normalize("NFC", name)):
        if ord(c) not in DROPPED:
            new = UNIFIED.get(ord(c), c.lower())
            out.append(new)
            places.extend([i] * len(new))
    return "".join(out), places


def marked(name: str, query: str, exact: bool = False) -> str | None:
    """The name in HTML with its hit in mark elements, recognised affixes and gaps in ctx ones; null without a hit."""
    text = unicodedata.normalize("NFC", name)
    norm, places = with_index(text)
    wanted, _ = with_index(query.strip())
    if not wanted:
        return html.escape(text).replace("&#x27;", "&#39;")
    start = norm.find(wanted)
    if start >= 0:
        hits = list(range(start, start + len(wanted)))
    else:
        hits, at = [], -1
        for c in wanted if not exact else "":
            at = norm.find(c, at + 1)
            if at < 0:
                return None
            hits.append(at)
        if not hits:
            return None
    first, last = hits[0], hits[-1] + 1
    left = norm.rfind(" ", 0, first) + 1
    right = norm.find(" ", last)
    right = len(norm) if right < 0 else right
    if norm[left:first] in PREFIXES:
        first = left
    if norm[last:right] in SUFFIXES:
        last = right
    begin, end = places[first], places[last] if last < len(places) else len(text)
    bright = {places[h] for h in hits}
    escape = lambda s: html.escape(s).replace("&#x27;", "&#39;")
    out, i = [escape(text[:begin])], begin
    while i < end:
        j = i
        while j < end and (j in bright) == (i in bright):
            j += 1
        out.append(f'<mark{"" if i in bright else " class=" + chr(34) + "ctx" + chr(34)}>{escape(text[i:j])}</mark>')
        i = j
    return "".join(out) + escape(text[end:])


def highlights(rows: DataFrame, name: str, query: str, exact: bool = False) -> DataFrame:
    """Adds marked, the highlighted name (batches of names in Python; apply it to the page of hits shown)."""
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else marked(x, query, exact))

    return rows.withColumn("marked", run(F.col(name)))
