"""Token chunks for training, truncation, and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_starts(size: Column, window: int, step: int) -> Column:
    """0, step, 2 * step ... as long as a window fits; 0 alone for shorter input."""
    last = F.greatest(size - window, F.lit(0))
    return F.sequence(F.lit(0), last, F.lit(step))


def token_windows(tokens: Column, window: int = 128, step: int = 64) -> Column:
    return F.transform(window_starts(F.size(tokens), window, step), lambda s: F.slice(tokens, s + 1, F.lit(window)))


def token_chunks(df: DataFrame, ids: str, size: int = 512, stride: int = 512, pad: int = 0, ignored: int = -100) -> DataFrame:
    """One row for each chunk, with ``chunk``, ``input_ids``, ``attention_mask`` and ``labels`` of length ``size``.

    Chunks start at each multiple of ``stride`` below the length. A short one is padded; its first
    padding token, the end mark, is inside mask and labels. No tokens give no chunks.
    """
    own = F.col(ids)
    starts = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = df.withColumn("_start", F.explode(starts)).withColumn("_real", F.slice(own, F.col("_start") + 1, size))
    missing = F.lit(size) - F.size("_real")
    marked = F.least(F.size("_real") + 1, F.lit(size))
    full = F.concat("_real", F.array_repeat(F.lit(pad), missing))
    chunk = cut.withColumn("chunk", (F.col("_start") / stride).cast("int")).withColumn("input_ids", full)
    chunk = chunk.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), marked), F.array_repeat(F.lit(0), F.lit(size) - marked)))
    labels = F.concat(F.slice("input_ids", F.lit(1), marked), F.array_repeat(F.lit(ignored), F.lit(size) - marked))
    return chunk.withColumn("labels", labels).drop("_start", "_real")


def truncate_tokens(text: Column, tokens: Column, most: int = 512) -> Column:
    """The first ``most`` tokens joined by spaces; a text with no more of them as it is."""
    return F.when(F.size(tokens) > most, F.array_join(F.slice(tokens, 1, most), " ")).otherwise(text)
