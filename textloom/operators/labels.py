"""Labels of multi-label samples: counts, the labels kept, samples, multi-hot vectors and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import code_prefix, split_words


def label_array(codes: Column | str) -> Column:
    """The first three characters, in lower case, of each code between white space."""
    return F.transform(split_words(codes), lambda c: code_prefix(c))


def label_counts(df: DataFrame, key: str, codes: str) -> DataFrame:
    """(label, n, first_key, first_pos): how often each label occurs, repeats in a row counted, and where first."""
    each = df.filter(F.col(codes).isNotNull()).select(F.col(key).alias("k"), F.posexplode(label_array(codes)).alias("pos", "label"))
    first = F.min(F.struct("k", "pos"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("n"), first["k"].alias("first_key"), first["pos"].alias("first_pos"))


def distinct_labels(df: DataFrame, codes: str) -> DataFrame:
    """(label): the labels that are there."""
    return df.select(F.explode(label_array(codes)).alias("label")).distinct()


def top_labels(counts: DataFrame, n_keep: int = 50, percentage: float | None = None) -> DataFrame:
    """The most frequent labels, ties by first occurrence: ``percentage`` of all (rounded down) if given, else ``n_keep``."""
    n = int(counts.count() * percentage / 100) if percentage else n_keep
    return counts.orderBy(F.col("n").desc(), "first_key", "first_pos").limit(n)


def keep_labels(df: DataFrame, codes: str, allowed: list[str], max_labels: int = 10, text: str | None = None) -> DataFrame:
    """Adds ``labels``, the allowed ones in order (repeats kept), at most ``max_labels``; rows without any are dropped.

    Null texts become empty.
    """
    kept = F.slice(F.filter(label_array(codes), lambda c: c.isin(*allowed)), 1, max_labels)
    out = df.withColumn("labels", kept).filter(F.size("labels") > 0)
    return out.withColumn(text, F.coalesce(F.col(text), F.lit(""))) if text else out


def multi_hot(labels: Column | str, label_list: list[str]) -> Column:
    """1 for each label of the list that the row has, else 0."""
    own = F.col(labels) if isinstance(labels, str) else labels
    return F.array(*[F.array_contains(own, F.lit(x)).cast("float") for x in label_list])


def positive_weights(df: DataFrame, labels: str, label_list: list[str]) -> DataFrame:
    """(label, pos, weight): negatives for each positive, of which at least one is assumed."""
    n = F.count(F.lit(1))
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.array_contains(F.col(labels), F.lit(x)).cast("int").alias("y")) for x in label_list])
    counted = df.select(F.inline(each)).groupBy("label").agg(n.alias("_n"), F.sum("y").cast("bigint").alias("pos"))
    return counted.select("label", "pos", ((F.col("_n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1))).alias("weight"))
