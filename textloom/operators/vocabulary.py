"""Vocabularies: word counts, percentile bands and stop words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import letter_words

# Common function words of English and French, a choice of our own; others are an argument.
STOPWORDS = ("a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "leur", "mais", "ne", "nous", "ou", "par", "pas", "pour", "que", "qui", "sa", "se", "ses", "son", "sur", "un", "une", "vous")
LOW, HIGH = 85.0, 99.5


def stopword_table(spark: SparkSession, words: tuple[str, ...] = STOPWORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(set(words))], "stopword string")


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of the lower-cased runs of letters."""
    return docs.select(F.explode(letter_words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def percentile_band(counts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row with the counts at the two percentiles, interpolated."""
    return counts.agg(F.percentile("n", F.lit(low / 100)).alias("low"), F.percentile("n", F.lit(high / 100)).alias("high"))


def filter_vocabulary(counts: DataFrame, low: float = LOW, high: float = HIGH, min_length: int = 3, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """Words in the band (ends included) that are long enough and no stop words."""
    band = percentile_band(counts, low, high).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    kept = counts.filter((F.length("word") >= min_length) & ~F.col("word").isin(*stopwords))
    return kept.join(F.broadcast(band), F.col("n").between(F.col("_low"), F.col("_high"))).select("word", "n")
