"""Line-first cleaning rules in SQL functions.

Every line is judged by itself: navigation (short items between separators), markup or symbol noise, shouting, lines
that came before in the same document, boilerplate phrases, and the lack of any closing punctuation.  Failing lines are
removed, and a document is rejected when it loses too much of its text, or by the base rules.

Null and empty texts have no words and are rejected (fewer words than the least).  A repeated row is judged like the
first.  Columns beyond ``doc_id, text`` play no part.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: Java patterns.  White space of words is that of ASCII.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Phrases of lines that sites repeat on every page.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|sign (in|up)|log ?in|subscribe|"
    r"click here|read more|share (this|on)|powered by|copyright|newsletter|enable javascript)\b"
)
#: A line of navigation has this many separators, and items of at most this many characters on average.
NAVIGATION_SEPARATORS, NAVIGATION_ITEM = 3, 24
#: Share of symbols, and of capital letters among letters, from which a line fails; lines shorter than this are not held to capitals.
SYMBOL_SHARE, CAPITAL_SHARE, CAPITAL_LENGTH = 0.1, 0.8, 20
#: A line of boilerplate is at most this long.
BOILERPLATE_LENGTH = 200
#: Share of a document's characters that failing lines may take, and share that lines without punctuation may take.
LOST_SHARE, OPEN_SHARE = 0.5, 0.9


def words_of(text: Column) -> Column:
    """Words of a text as an array."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that come twice or more.

    Windows are sorted by a hash with their place; equal neighbours are repeated, and each repeated place covers the
    words that no repeated place before it covers.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    coded = F.when(F.size(words) >= 3, F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))).otherwise(F.array())
    return _covered(F.sort_array(coded))


def _covered(coded: Column) -> Column:
    def same(a, b):
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    # A named array is computed once; an expression inside a lambda would be computed per element.
    def count(arrays):
        repeated = F.sort_array(F.transform(F.filter(F.transform(arrays, lambda x, k: F.struct(
            (same(x, F.get(arrays, k - 1)) | same(x, F.get(arrays, k + 1))).alias("r"), x["i"].alias("i"))), lambda x: x["r"]), lambda x: x["i"]))
        return F.aggregate(repeated, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])

    return F.get(F.transform(F.array(coded), count), 0)


def line_fails(line: Column) -> Column:
    """True for a line that a rule of its own removes."""
    solid = F.length(F.regexp_replace(line, BLANK, ""))
    symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    separators = F.size(F.split(line, r"\s[|>»·•/]\s")) - 1
    navigation = (separators >= NAVIGATION_SEPARATORS) & (F.length(line) / (separators + 1) <= NAVIGATION_ITEM)
    noise = symbols > SYMBOL_SHARE * solid
    shouting = (letters >= CAPITAL_LENGTH) & (capitals > CAPITAL_SHARE * letters)
    boilerplate = (F.length(line) <= BOILERPLATE_LENGTH) & line.rlike(BOILERPLATE)
    return navigation | noise | shouting | boilerplate


def _solid_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _judged(docs: DataFrame) -> DataFrame:
    """Named working columns; each is computed once per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.withColumn("__lines", _solid_lines(text)).withColumn("__once", F.array_distinct("__lines"))
    good = F.filter("__once", lambda line: ~line_fails(line))
    size = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    lines = lines.withColumn("__good", good).withColumn("__all_chars", size(F.col("__lines"))).withColumn("__good_chars", size(F.col("__good")))
    ended = F.filter("__good", lambda line: line.rlike(r"[.!?…。！？:;\"'»”)\]][\x20\x09-\x0D]*$"))
    return lines.withColumn("__open_chars", F.col("__good_chars") - size(ended))


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with failing lines removed from ``text`` (a repeated line stays once), without documents that lose too much."""
    judged = _judged(docs).where(_verdict())
    return judged.withColumn("text", F.array_join("__good", "\n")).select(*docs.columns)


def _verdict() -> Column:
    lost = F.col("__good_chars") >= (1 - LOST_SHARE) * F.col("__all_chars")
    return (F.col("__all_chars") > 0) & lost & (F.col("__open_chars") <= OPEN_SHARE * F.col("__good_chars"))


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars.

    ``kept_chars`` are the characters of the lines that stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = _judged(docs.select("doc_id", "text")).withColumn("__words", words_of(text))
    measured = judged.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size("__once")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        _verdict().alias("__passes"), F.col("__good_chars").alias("kept_chars"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("__passes")).alias("kept"), "kept_chars")
