"""Metrics of multi-label predictions over a long table (dataset, sample, label, y, logit)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import sigmoid


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def predictions(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``prob`` and ``p``, 1 above the threshold."""
    return long.withColumn("prob", sigmoid(F.col("logit"))).withColumn("p", (F.col("prob") > threshold).cast("int"))


def _confusion() -> list[Column]:
    y, p = F.col("y"), F.col("p")
    return [F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn")]


def _three() -> tuple[Column, Column, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _ratio(2 * tp, 2 * tp + fp + fn), _ratio(tp, tp + fp), _ratio(tp, tp + fn)


def hamming_loss(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("dataset").agg(F.avg((F.col("y") != F.col("p")).cast("int")).alias("hamming_loss"))


def sample_jaccard(predicted: DataFrame) -> DataFrame:
    """The mean over samples of hits by labels that are true or predicted."""
    rows = predicted.groupBy("dataset", "sample").agg(*_confusion())
    return rows.groupBy("dataset").agg(F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))).alias("jaccard"))


def macro_scores(predicted: DataFrame) -> DataFrame:
    f1, precision, recall = _three()
    rows = predicted.groupBy("dataset", "label").agg(*_confusion())
    return rows.groupBy("dataset").agg(F.avg(f1).alias("macro_f1"), F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"))


def micro_scores(predicted: DataFrame) -> DataFrame:
    f1, precision, recall = _three()
    return predicted.groupBy("dataset").agg(*_confusion()).select("dataset", f1.alias("micro_f1"), precision.alias("micro_precision"), recall.alias("micro_recall"))


def f1_at_k(predicted: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """The mean over samples of F1 with the k likeliest labels as predicted; a k above the number of labels is left out."""
    order = Window.partitionBy("dataset", "sample").orderBy(F.col("prob").desc(), "label")
    ranked = predicted.withColumn("_rank", F.row_number().over(order))
    hits = [F.sum(F.when(F.col("_rank") <= k, F.col("y")).otherwise(0)).alias(f"_tp{k}") for k in ks]
    rows = ranked.groupBy("dataset", "sample").agg(F.sum("y").alias("_pos"), F.count(F.lit(1)).alias("_n"), *hits)
    means = rows.groupBy("dataset").agg(*[F.avg(F.when(F.col("_n") >= k, 2 * F.col(f"_tp{k}") / (F.lit(k) + F.col("_pos")))).alias(f"f1_at_{k}") for k in ks])
    return means


def all_metrics(long: DataFrame, threshold: float = 0.5, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """All metrics of each dataset in one row."""
    predicted = predictions(long, threshold)
    parts = [hamming_loss(predicted), sample_jaccard(predicted), macro_scores(predicted), micro_scores(predicted), f1_at_k(predicted, ks)]
    return reduce(lambda a, b: a.join(b, "dataset"), parts)
