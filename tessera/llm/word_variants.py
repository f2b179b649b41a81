"""Spelling variants of a corpus' words, found through wildcard groups without making pairs of words.

Words are the maximal runs of a character class, counted over all whole texts. Two words are near if they differ by
one inserted, deleted or replaced code point. Every word stands in a group per position: (position, prefix, suffix),
written as the word with the position blanked out. A group keeps its size and its first two words (largest count,
then code-point order): a member has size - 1 near words there, and its best one is the first, or the second if it is
the first itself. Replaced letters are thus counted and chosen without a pair. For inserted and deleted letters,
every word stands under each of its deletions (runs of equal letters once), and each word of the vocabulary under itself:
where both meet, the word has as many near words as there are longer ones, and each longer one has it. A near word
is met in one group only, so sizes add up.

What meets under one key is bounded by the class: at most one word per letter of it under a blanked word, and per
letter and position under a deletion (90 letters by default); a frequent word is one row of the vocabulary. Counting
has partial sums. The chain of forms is followed by doubling, over the words that have a form; counts grow at least twofold
along it, so it is short and ends.

Defined results: null and empty texts hold no words; a null id is an empty one in the checksum; repeated rows count
each; equal counts fall to the smaller word; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Letters of words, after A-Z were lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Stands for the blanked position; not a letter.
BLANK = "*"


def words_of(docs: DataFrame, letters: str = LETTERS, slip: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row ``word`` per run of letters, A-Z lower-cased.

    With ``slip``, a run whose checksum CRC-32 of "id:run" is divisible by it loses the code point at checksum % length.
    """
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.col(doc_id).alias("_id"), F.explode(F.regexp_extract_all(plain, F.lit(f"[{letters}]+"), F.lit(0))).alias("word"))
    if slip is None:
        return runs.select("word")
    sum_ = F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    summed = runs.withColumn("_sum", sum_)
    at = (F.col("_sum") % F.char_length("word")).cast("int")
    slipped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return summed.select(F.when(F.col("_sum") % slip == 0, slipped).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """Words of at least ``shortest`` code points with their counts ``n``, where these are at least ``least``."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _without(p, blank: str):
    """The word without its letter number p (from 1), or with it blanked."""
    return F.concat(F.substring("word", F.lit(1), p - 1), F.lit(blank), F.substring("word", p + 1, F.char_length("word")))


def near(vocab: DataFrame) -> DataFrame:
    """Words that have near ones: word, n_near, best (struct: minus the count, word)."""
    p = F.col("p")
    places = vocab.select("word", F.struct((-F.col("n")).alias("m"), "word").alias("own"), F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("p"))
    first_of_run = (p == 1) | (F.substring("word", p, F.lit(1)) != F.substring("word", p - 1, F.lit(1)))
    keys = F.concat(F.array(_without(p, BLANK)), F.when(first_of_run, F.array(_without(p, ""))).otherwise(F.array().cast("array<string>")))
    members = places.select(F.explode(keys).alias("key"), F.col("own").alias("member"), F.lit(None).cast("struct<m:bigint,word:string>").alias("self"))
    selves = vocab.select(F.col("word").alias("key"), F.lit(None).cast("struct<m:bigint,word:string>").alias("member"), F.struct((-F.col("n")).alias("m"), "word").alias("self"))
    # At most a word per letter (and position) under a key.
    groups = members.unionByName(selves).groupBy("key").agg(F.sort_array(F.collect_list("member")).alias("members"), F.max("self").alias("self"))
    size, first, second = F.size("members").cast("long"), F.get("members", F.lit(0)), F.get("members", F.lit(1))
    told = lambda word, k, best: F.struct(word.alias("word"), k.alias("k"), best.alias("best"))
    replaced = F.transform("members", lambda x: told(x.word, size - 1, F.when(x.word == first.word, second).otherwise(first)))
    shorter = F.transform("members", lambda x: told(x.word, F.lit(1).cast("long"), F.col("self")))
    blanked = F.contains("key", F.lit(BLANK))
    messages = F.when(blanked & (size > 1), replaced).when(F.col("self").isNotNull() & (size > 0), F.concat(shorter, F.array(told(F.col("key"), size, first))))
    sent = groups.where((blanked & (size > 1)) | (F.col("self").isNotNull() & (size > 0))).select(F.explode(messages).alias("x")).select("x.*")
    return sent.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last of the chain of forms."""
    at = C.written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = C.written(at.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("on")), "forms")
        C.forget(at)
        if step.where("on").isEmpty():
            return step.select("word", "root")
        at = step.drop("on")
        at.written_to = step.written_to


def variants(docs: DataFrame, letters: str = LETTERS, slip: int | None = None, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """Word, n, n_near, form (its best near word, if that has at least ``times`` its count), form_n, root."""
    vocab = C.written(vocabulary(words_of(docs, letters, slip), shortest, least), "vocabulary")
    found = near(vocab).withColumnRenamed("word", "_word")
    fits = -F.col("best.m") >= times * F.col("n")
    table = vocab.join(found, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    table = C.written(table, "variants")
    ends = roots(table.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "_word")
    return table.join(ends, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
