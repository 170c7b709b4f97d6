"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut_table, discard
from textloom.llm.decontaminate import find_overlaps, is_contaminated
from textloom.llm.line_dedup import drop_boilerplate
from textloom.llm.mixing import mix_sources
from textloom.llm.near_dup import one_of_each
from textloom.llm.toxicity import learn, score_toxicity

#: Documents from this score on are rejected.
TOXIC_FROM = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """``COLUMNS`` and ``others``, a struct of all further columns, so that no name meets one that a stage adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    return docs.select(*[c for c in COLUMNS if c in docs.columns], *([F.struct(*others).alias("others")] if others else []))


def unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(c) if c in COLUMNS else F.col("others")[c].alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below ``TOXIC_FROM``.

    Null and empty texts and texts without a flagged token are kept, as are all where labels are
    too few to learn from. Repeated rows are judged alike; further columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = packed(docs)
    scored = score_toxicity(own, learn(own, labels))
    return unpacked(scored.filter(F.col("score") < TOXIC_FROM), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source.

    A document of which nothing would be left stays as it is: all its lines are those of other
    pages, so it is a copy or part of a group of copies, of which the next stage keeps one. Null
    and empty texts stay; a null source is a source of its own; ``n_chars`` follows the text where
    lines went. Further columns pass through.
    """
    own = packed(docs).withColumn("before", F.col("text"))
    cleaned = drop_boilerplate(own)
    went = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"^[\x20\x09-\x0D]*$")
    went = F.coalesce(went, F.lit(False))
    n_chars = F.when(went, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    done = cleaned.withColumn("n_chars", n_chars).withColumn("text", F.when(went, F.col("text")).otherwise(F.col("before")))
    return unpacked(done, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the least id.

    Null and empty texts are equal to each other; of repeated rows one stays, and null ids come
    after all others. Further columns pass through.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words at least a twentieth is in passages of the benchmark.

    Null and empty texts have no words and stay, repeated rows are judged alike, an empty benchmark
    drops nothing, and further columns pass through.
    """
    found = find_overlaps(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(found.filter(~is_contaminated()), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``) and how many words that makes.

    Null and empty texts may be taken, a null source is one of its own, and repeated rows are
    documents of their own. Columns named like the new ones are replaced, others pass through.
    """
    return mix_sources(docs).filter(F.col("copies") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL cannot express the trained and the sampled stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and deleted once the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        before, docs = docs, cut_table(done)
        discard(before)
    return docs
