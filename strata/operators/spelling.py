"""Correction candidates from the corpus itself, by a symmetric-delete index.

A word is spelled in letters (a Hangul syllable is its two or three jamo, so one wrong vowel
is one wrong letter). Every word goes into the index under each of its spellings with one letter left out;
two words are one edit apart exactly when they meet there: under the same gap (a replaced letter),
or one's spelling with a gap is the other's whole spelling (a letter too many or too few).

Words that meet under one key differ in a single letter, so a key has no more words than the alphabet
has letters, however frequent the words are: the index is joined by keys that cannot be hot. Counting
comes first and is combined map-side, so a word that is a third of all tokens is one row here.
Of the first side, which has all words, only entries go to the join whose key may be among the
second's (a Bloom filter); most words have no neighbour, and their entries are many times the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.text import col_of
from strata.operators.membership import member_filter

# Fixed values of the Hangul blocks: syllables from U+AC00, 28 finals (none included) and 21 vowels.
FIRST_SYLLABLE, FINALS, VOWELS = 0xAC00, 28, 21
LEADS, MEDIALS, TAILS = ("".join(chr(at + i) for i in range(n)) for at, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

#: Shortest spelling that is corrected, least count of a correction, and how many times the wrong word's count it must have.
MIN_LETTERS, MIN_COUNT, RATIO = 4, 5, 10


def letters(c: str | Column) -> Column:
    """The spelling of a word: Hangul syllables as jamo, every other character as itself."""
    c = col_of(c)

    def spell(ch: Column) -> Column:
        i = F.ascii(ch) - FIRST_SYLLABLE
        pick = lambda block, at: F.substr(F.lit(block), at.cast("int"), F.lit(1))
        lead = pick(LEADS, F.floor(i / (VOWELS * FINALS)) + 1)
        vowel = pick(MEDIALS, F.floor(i % (VOWELS * FINALS) / FINALS) + 1)
        tail = F.when(i % FINALS > 0, pick(TAILS, i % FINALS)).otherwise("")
        return F.when(ch.between("가", "힣"), F.concat(lead, vowel, tail)).otherwise(ch)

    spelled = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), spell), "")
    return F.when(c.rlike("[가-힣]"), spelled).otherwise(c)


def word_counts(df: DataFrame, cols: tuple[str, ...] = ("text",), sep: str = " ") -> DataFrame:
    """(word, n) over the tokens of one or several text columns; empty tokens are none."""
    tokens = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), sep) for c in cols]))
    return df.select(F.explode(tokens).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# How two words meet: at the same gap (its place, from 1), the first one's gap at the second's whole spelling, or the other way round.
FIRST_LONGER, SECOND_LONGER = 0, -1


def delete_index(words: DataFrame, second: bool) -> DataFrame:
    """(key, how, word columns): the entries of ``words`` (word, n, spelling) as first or second side of a meeting."""
    gaps = words.withColumn("how", F.explode(F.sequence(F.lit(1), F.length("spelling"))))
    gaps = gaps.withColumn("key", F.expr("concat(substring(spelling, 1, how - 1), substring(spelling, how + 1))"))
    # Leaving out either of two equal neighbours gives one spelling: entered once.
    once = F.expr("substring(spelling, how, 1) <> substring(spelling, how + 1, 1)")
    own, other = (SECOND_LONGER, FIRST_LONGER) if second else (FIRST_LONGER, SECOND_LONGER)
    shorter = gaps.filter(once).withColumn("how", F.lit(own))
    whole = words.withColumn("how", F.lit(other)).withColumn("key", F.col("spelling"))
    return gaps.unionByName(shorter).unionByName(whole)


def near_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(word, n) tables -> (word, n, other, other_n): every pair exactly one letter apart, once. ``second`` is read twice."""
    spelled = lambda df: df.select("word", "n", letters("word").alias("spelling"))
    index = lambda df, side: delete_index(spelled(df), side).select("key", "how", "word", "n")
    entry = F.xxhash64("key", "how")
    a, b = index(first, False), index(second, True).select("key", "how", F.col("word").alias("other"), F.col("n").alias("other_n"))
    entries = second.agg(F.sum(2 * F.length(letters("word")) + 1)).first()[0] or 0
    met = a.filter(member_filter(b.select(entry), entries)(entry)).join(b, ["key", "how"]).filter("word <> other")
    return met.filter(F.levenshtein(letters("word"), letters("other")) == 1).select("word", "n", "other", "other_n")


def correction_candidates(counts: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> (wrong, right, wrong_n, right_n, candidates): for each word with a much more
    frequent word one letter apart, the most frequent such word (ties: the first by code point).

    ``counts`` is read four times and should be a table; its counts start at 1.
    """
    long = counts.filter(F.length(letters("word")) >= min_letters)
    pairs = near_pairs(long, counts.filter(F.col("n") >= max(min_count, ratio))).filter(F.col("other_n") >= ratio * F.col("n"))
    best = pairs.groupBy("word", "n").agg(F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("w"))).alias("b"), F.count(F.lit(1)).alias("candidates"))
    return best.select(F.col("word").alias("wrong"), F.col("b.w").alias("right"), F.col("n").alias("wrong_n"), (-F.col("b.less")).alias("right_n"), "candidates")
