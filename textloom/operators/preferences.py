"""Training sets from scored candidates: supervised, binary preference, and best-and-worst pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import known
from textloom.operators.candidates import SORTS, best, worst
from textloom.operators.ordering import train_test_split

TOP_N = 5000
SCORES = ("similarity_score", "educational_score", "bleu_score", "cumulative_score")


def supervised_set(candidates: DataFrame, top_n: int = TOP_N, sort: str = "avg") -> DataFrame:
    return best(candidates, top_n, sort)


def binary_set(candidates: DataFrame, top_n: int = TOP_N, sort: str = "avg", disjoint: bool = False) -> DataFrame:
    """The best candidates with label true and the last ones with label false.

    With fewer than twice ``top_n`` candidates, some carry both labels, unless ``disjoint``.
    """
    good, bad = best(candidates, top_n, sort), worst(candidates, top_n, sort)
    if disjoint:
        bad = bad.join(good.select("example_id", "candidate_id"), ["example_id", "candidate_id"], "left_anti")
    both = good.withColumn("label", F.lit(True)).unionByName(bad.withColumn("label", F.lit(False)))
    return both.select("instruction", "response", "label", F.col("response").alias("completion"), F.col("instruction").alias("prompt"))


def sets_from_ranks(ranked: DataFrame, total: int, top_n: int = TOP_N) -> tuple[DataFrame, DataFrame]:
    """The supervised and the binary set with their ranks, from a table of ``total`` candidates with ``rank``; nothing is sorted again.

    The rows are those of ``supervised_set`` and ``binary_set``.
    """
    good, bad = ranked.filter(F.col("rank") <= top_n), ranked.filter(F.col("rank") > total - top_n)
    both = good.withColumn("label", F.lit(True)).unionByName(bad.withColumn("label", F.lit(False)))
    return good, both.select("rank", "instruction", "response", "label", F.col("response").alias("completion"), F.col("instruction").alias("prompt"))


def preference_pairs(candidates: DataFrame, top_n: int = TOP_N, sort: str = "avg") -> DataFrame:
    """The best and the worst response of each example that has a candidate among the ``top_n`` best.

    Best and worst are taken from all candidates of the example. ``rank`` is the order of the
    pairs, by their best candidate. One aggregation by example finds both ends.
    """
    top = best(candidates, top_n, sort).select(F.col("example_id").alias("_seen")).distinct()
    # A key whose greatest value is the best candidate: nulls are below all scores, ties go to the first.
    key = F.struct(*[F.struct(known(F.col(c)).isNotNull().alias("there"), known(F.col(c)).alias("score")).alias(c) for c in SORTS[sort]], (-F.col("candidate_id")).alias("first"))
    row = F.struct("instruction", "response", *SCORES)
    ends = candidates.join(top, F.col("example_id") == F.col("_seen"), "left_semi").groupBy("example_id").agg(F.max_by(row, key).alias("top"), F.min_by(row, key).alias("low"), F.max(key).alias("best"))
    pairs = ends.select("example_id", "best", F.col("top.instruction").alias("instruction"), F.col("top.response").alias("chosen"), F.col("low.response").alias("rejected"), *[F.col(f"{side}.{s}").alias(f"{name}_{s}") for side, name in (("top", "chosen"), ("low", "rejected")) for s in SCORES])
    order = [F.col(f"best.{c}.score").desc_nulls_last() for c in SORTS[sort]] + [F.col("example_id")]
    # At most top_n rows are left here, so ranking them in one task is bounded.
    return pairs.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("best", "example_id")


def trainer_input(pairs: DataFrame, n: int = 900, share: float = 0.1, seed: int = 42) -> DataFrame:
    """prompt, chosen and rejected of the first ``n`` pairs, with their split."""
    first = pairs.filter(F.col("rank") <= n) if n >= 0 else pairs
    return train_test_split(first.select("rank", F.col("instruction").alias("prompt"), "chosen", "rejected"), "rank", share, seed)
