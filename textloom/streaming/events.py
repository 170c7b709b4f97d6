"""Stateless text operators on streams, and running counts with late data handled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text
from textloom.operators.labels import label_array


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalized_stream(stream: DataFrame, text: str, into: str = "normalized") -> DataFrame:
    return stream.withColumn(into, normalize_text(text))


def running_label_counts(stream: DataFrame, codes: str) -> DataFrame:
    """(label, n) so far, for output mode complete."""
    return stream.select(F.explode(label_array(codes)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) by event time; state is dropped once a window is later than the watermark."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")
