"""Tokens, sentences, syllables, lexicon counts and readability, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.pylike import py_round

COUNTS = ["word_count", "sentence_count", "positive_count", "negative_count", "uncertainty_count", "litigious_count"]
RATIOS = ["net_sentiment_score", "fog_index", "flesch_reading_ease", "complex_word_ratio"]


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters that are whole words in Unicode."""
    # One search of the whole text; the runs that don't count come back empty.
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]++)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]++"), F.lit(1))
    return F.array_remove(runs, "")


def sentence_count(text: Column) -> Column:
    # More than five characters from the first to the last that is no white space.
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: s.rlike(r"(?Us)[^\s\x1c-\x1f].{4,}[^\s\x1c-\x1f]"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.size(pieces)))


def syllables(word: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(word, r"(?:[^laeiouy]|ed|es|e)$", ""), "^y", "")
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]{1,2}"))))


def syllable_counts(tokens: Column) -> Column:
    """syllables() of the tokens (of ASCII letters) that have more than three, by searches of all of
    them at once; 1 if none has. A last consonant that syllables() drops holds no vowel, so it may stay."""
    each = F.concat(F.lit(" "), F.array_join(F.filter(tokens, lambda w: F.length(w) > 3), " "))
    stems = F.replace(F.regexp_replace(each, "e[ds]?(?= |$)", ""), F.lit(" y"), F.lit(" "))
    counts = F.regexp_replace(F.regexp_replace(stems, "[aeiouy]{1,2}", "1"), "[a-z]+", "")
    return F.transform(F.split(F.substring(counts, 2, 1 << 30), " "), lambda x: F.greatest(F.lit(1), F.length(x)))


def lexicon_count(tokens: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*lexicon)))


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the ten text metrics. Text without words: zeros, but for its sentences."""
    df = df.withColumn("__w", words(F.col(text))).withColumn("__s", syllable_counts(F.col("__w")))
    n, w = F.size("__w"), F.col("__w")
    short = F.size(F.filter("__w", lambda x: F.length(x) <= 3))  # of one syllable each
    df = df.withColumns({
        "word_count": n, "sentence_count": sentence_count(F.col(text)), "positive_count": lexicon_count(w, fixed.POSITIVE), "negative_count": lexicon_count(w, fixed.NEGATIVE),
        "uncertainty_count": lexicon_count(w, fixed.UNCERTAINTY), "litigious_count": lexicon_count(w, fixed.LITIGIOUS),
        "__syl": F.when(n > short, F.aggregate("__s", F.lit(0), lambda a, x: a + x)).otherwise(0) + short, "__complex": F.size(F.filter("__s", lambda x: x >= 3)),
    })
    some = F.col("word_count") > 0
    of_words = F.nullif(F.col("word_count"), F.lit(0))
    rate = F.col("word_count") / F.nullif("sentence_count", F.lit(0))
    ratio = F.col("__complex") / of_words
    pos, neg = F.col("positive_count"), F.col("negative_count")
    ease = 206.835 - 1.015 * rate - 84.6 * (F.col("__syl") / of_words)
    exact = {
        "net_sentiment_score": py_round((pos - neg) / (pos + neg + 1), 4), "fog_index": py_round(0.4 * (rate + 100 * ratio), 2),
        "flesch_reading_ease": py_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)), 2), "complex_word_ratio": py_round(ratio, 4),
    }
    return df.withColumns({k: F.when(some, v).otherwise(F.lit(0.0)) for k, v in exact.items()}).drop("__w", "__s", "__syl", "__complex")
