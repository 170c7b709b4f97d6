"""Candidate responses: from a wide scored table to a long one, scores, order and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.scores import keyword_overlap, known, mean_of
from textloom.functions.text import normalize_text
from textloom.operators.ordering import ordinal_within, with_ordinal

#: Columns of the wide table, by what they are called in the long one.
LONG = {"response": "response", "similarity_score": "similarity_score", "educational_score": "educational_score", "bleu_score": "bleu_score", "cumulative_score": "cumulative_score"}

#: Orders by name: the columns, all descending. ``avg`` is the one in use.
SORTS = {
    "avg": ("cumulative_score",),
    "mes": ("cumulative_score", "educational_score", "similarity_score"),
    "ms": ("cumulative_score", "similarity_score"),
    "s": ("similarity_score",),
    "e": ("educational_score",),
    "se": ("similarity_score", "educational_score"),
}


def candidate_numbers(wide: DataFrame) -> list[int]:
    """The numbers i of the columns ``response_i``."""
    return sorted(int(m[1]) for c in wide.columns if (m := re.fullmatch(r"response_(\d+)", c)))


def zip_positional(left: DataFrame, right: DataFrame, ordinal: str, prefix: str = "public_") -> DataFrame:
    """Row i of ``left`` with row i of ``right``; the shorter side ends it. Columns of the right get a prefix."""
    other = right.select(F.col(ordinal).alias("_at"), *[F.col(c).alias(prefix + c) for c in right.columns if c != ordinal])
    return left.join(other, F.col(ordinal) == F.col("_at")).drop("_at")


def add_cumulative(wide: DataFrame) -> DataFrame:
    """Adds ``cumulative_score_i``: the mean of keyword overlap, educational score and similarity."""
    return wide.withColumns({f"cumulative_score_{i}": mean_of(F.col(f"overlap_keys_{i}"), F.col(f"educational_score_{i}"), F.col(f"similarity_score_{i}")) for i in candidate_numbers(wide)})


def unpivot_candidates(wide: DataFrame, ordinal: str = "example_id", instruction: str = "instruction", columns: dict[str, str] = LONG) -> DataFrame:
    """One row for each candidate; ``columns`` are those of the wide table (without numbers) and their new names."""
    numbers = candidate_numbers(wide)
    rows = F.array(*[F.struct(F.lit(i).cast("int").alias("candidate_id"), *[F.col(f"{c}_{i}").alias(new) for c, new in columns.items()]) for i in numbers])
    return wide.select(F.col(ordinal).alias("example_id"), F.col(instruction).alias("instruction"), F.inline(rows))


def add_keyword_overlap(df: DataFrame, keywords: str, response: str, into: str = "overlap_keys") -> DataFrame:
    """Adds the share of keywords in the normalised response, which is normalised once for all of them."""
    return df.withColumn("_normal", normalize_text(F.coalesce(F.col(response), F.lit("")))).withColumn(into, keyword_overlap(F.col(keywords), "_normal")).drop("_normal")


def score_order(sort: str = "avg", descending: bool = True) -> list[Column]:
    """Best first, with null and NaN last; ties by example and candidate. Or the exact reverse."""
    if descending:
        return [known(F.col(c)).desc_nulls_last() for c in SORTS[sort]] + [F.col("example_id").asc(), F.col("candidate_id").asc()]
    return [known(F.col(c)).asc_nulls_first() for c in SORTS[sort]] + [F.col("example_id").desc(), F.col("candidate_id").desc()]


def ranked(candidates: DataFrame, sort: str = "avg") -> DataFrame:
    """All candidates with ``rank``, their place in the order of ``best``, from 1 on; no task sees all of them."""
    return with_ordinal(candidates, *score_order(sort), name="rank")


def best(candidates: DataFrame, n: int, sort: str = "avg") -> DataFrame:
    """The ``n`` best candidates."""
    return candidates.orderBy(*score_order(sort)).limit(n)


def worst(candidates: DataFrame, n: int, sort: str = "avg") -> DataFrame:
    """The ``n`` last candidates in the order of ``best``."""
    return candidates.orderBy(*score_order(sort, descending=False)).limit(n)


def score_statistics(wide: DataFrame, scores: tuple[str, ...] = ("similarity_score", "cumulative_score")) -> DataFrame:
    """mean, max, min and median of each kind of score over all candidates; NaN is left out.

    The median is exact, by ranks that are found without a task that sees all of a kind's scores.
    """
    numbers = candidate_numbers(wide)
    values = F.array(*[F.struct(F.lit(s).alias("metric"), known(F.col(f"{s}_{i}")).alias("value")) for s in scores for i in numbers])
    long = wide.select(F.inline(values))
    plain = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("value").alias("_n"))
    ranked = ordinal_within(long.filter("value is not null"), "metric", [F.col("value")], ["value"], name="_rank")
    sizes = F.broadcast(plain.select(F.col("metric").alias("_metric"), "_n"))  # a row for each kind
    middle = ranked.join(sizes, F.col("metric") == F.col("_metric")).filter(F.col("_rank").isin(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    medians = middle.groupBy(F.col("metric").alias("_metric")).agg(F.avg("value").alias("median"))
    return plain.join(medians, F.col("metric") == F.col("_metric"), "left").select("metric", "mean", "max", "min", "median")


def below_score(candidates: DataFrame, most: float = 6.0, score: str = "educational_score") -> DataFrame:
    """The candidates with a score below ``most``; those without a score go."""
    return candidates.filter(known(F.col(score)) < most)


def with_any(candidates: DataFrame, flag: str, group: str = "example_id") -> DataFrame:
    """The candidates of those examples of which any is flagged."""
    flagged = candidates.filter(F.col(flag)).select(F.col(group).alias("_flagged")).distinct()
    return candidates.join(flagged, F.col(group) == F.col("_flagged"), "left_semi")
