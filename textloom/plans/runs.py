"""Runs that chain the operators: one supervised run, and iterations that learn from its pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.bleu import sentence_bleu
from textloom.operators.candidates import add_cumulative, add_keyword_overlap, best, candidate_numbers, ranked, score_statistics, unpivot_candidates, zip_positional
from textloom.operators.plugins import EchoGenerator, Embedder, Generator, HashEmbedder, HeuristicJudge, Judge, Tokenizer, WordTokenizer, add_judge_score, add_similarity, generate_candidates
from textloom.operators.preferences import preference_pairs, sets_from_ranks
from textloom.functions.prompts import instruction_prompt
from textloom.operators.keywords import given_or_extracted, keywords_if_absent
from textloom.operators.labels import keep_labels, label_counts, top_labels
from textloom.operators.metrics import all_metrics
from textloom.sources.readers import read_folder, read_table
from textloom.sources.writers import write_by_file, write_counted, write_table

JUDGE_TEMPLATE = "Rate this text from 0 to 1.\n{INSTRUCTION}"


@dataclass
class Models:
    """The plug-ins of a run."""

    generator: Generator = field(default_factory=EchoGenerator)
    judge: Judge = field(default_factory=HeuristicJudge)
    embedder: Embedder = field(default_factory=HashEmbedder)
    tokenizer: Tokenizer = field(default_factory=WordTokenizer)


def score_candidates(seed: DataFrame, generated: DataFrame, models: Models, ordinal: str = "row") -> DataFrame:
    """The wide scored table of ``generated`` candidates, held row by row against the seed.

    Candidates are scored as long rows, so each model runs over one column and not once for each
    of them; then they are put side by side again.
    """
    numbers = candidate_numbers(generated)
    both = zip_positional(seed, generated, ordinal).withColumnRenamed(ordinal, "example_id")
    long = both.select("example_id", "instruction", "keywords", F.col("response").alias("private"), F.inline(F.array(*[F.struct(F.lit(i).alias("candidate_id"), F.col(f"public_response_{i}").alias("candidate")) for i in numbers])))
    long = add_similarity(long, "private", "candidate", models.embedder, models.tokenizer)
    long = add_judge_score(long, "candidate", models.judge, JUDGE_TEMPLATE)
    long = add_keyword_overlap(long, "keywords", "candidate")
    long = long.withColumn("_key", F.concat_ws("~", "example_id", "candidate_id"))
    long = long.join(sentence_bleu(long, "_key", "candidate", "private"), "_key").drop("_key")
    names = {"candidate": "response", "similarity_score": "similarity_score", "educational_score": "educational_score", "bleu_score": "bleu_score", "overlap_keys": "overlap_keys"}
    wide = long.groupBy("example_id", "instruction").agg(*[F.max(F.when(F.col("candidate_id") == i, F.col(c))).alias(f"{new}_{i}") for i in numbers for c, new in names.items()])
    return add_cumulative(wide)


def supervised_run(spark: SparkSession, seed_path: str, out: str, models: Models | None = None, n_candidates: int = 4, n_prompts: int = -1, top_n: int = 5000, sort: str = "avg") -> dict[str, str]:
    """Generates, scores and filters; the paths of the tables written below ``out``.

    Beside the training sets, ``sorted`` has all candidates and ``eval`` the ``top_n`` most similar
    ones, each with its ``rank``; the supervised and binary sets keep the rank in ``sorted``. The seed is one Parquet file with ``instruction``, ``keywords`` and ``response``.
    """
    models = models or Models()
    seed = read_table(spark, seed_path, "row")
    seed = seed if n_prompts < 0 else seed.filter(F.col("row") < n_prompts)
    paths = {name: f"{out}/{name}" for name in ("generated", "scored", "statistics", "sorted", "sft", "kto", "dpo", "eval", "counts")}
    rows = {"generated": write_counted(generate_candidates(seed.select("row", "instruction"), "instruction", models.generator, n_candidates), paths["generated"])}
    rows["scored"] = write_counted(score_candidates(seed, read_table(spark, paths["generated"]), models), paths["scored"])
    wide = read_table(spark, paths["scored"])
    write_table(score_statistics(wide), paths["statistics"])
    candidates = unpivot_candidates(wide)
    rows["sorted"] = write_counted(ranked(candidates, sort), paths["sorted"])
    good, both = sets_from_ranks(read_table(spark, paths["sorted"]), rows["sorted"], top_n)
    rows["sft"] = write_counted(good, paths["sft"])
    rows["kto"] = write_counted(both, paths["kto"])
    rows["dpo"] = write_counted(preference_pairs(candidates, top_n, sort), paths["dpo"])
    rows["eval"] = write_counted(ranked(best(candidates, top_n, "s"), "s"), paths["eval"])
    write_table(spark.createDataFrame(list(rows.items()), "stage string, n bigint"), paths["counts"])
    return paths


def preprocessing_run(spark: SparkSession, folder: str, out: str, template: str, terms: DataFrame, term: str, random_extraction: bool = False, **options) -> DataFrame:
    """Turns a folder of reports into a supervised seed, an output folder for each input file; what was written.

    Keywords are extracted unless the files have them, with ``random_extraction`` for about half of
    the rows, the others taking those in ``definitions``. The prompt goes into ``instruction``, and
    ``text`` becomes ``response``.
    """
    reports = read_folder(spark, folder, "_row")
    keyed = reports.withColumn("_row", F.concat_ws("~", "file", "_row"))
    text = "text" if "text" in reports.columns else "response"
    done = keywords_if_absent(keyed, "_row", text, terms, term, **options)
    if random_extraction:
        done = given_or_extracted(done, "_row", "definitions")
    done = done.withColumn("instruction", instruction_prompt(template, F.coalesce("keywords", F.lit("")))).withColumnRenamed("text", "response").drop("_row")
    write_by_file(done, out)
    return spark.read.parquet(out)


def evaluate(train: DataFrame, sets: dict[str, DataFrame], key: str, text: str, codes: str, logit: Callable[[str, str], Column], n_keep: int = 50, percentage: float | None = None, max_labels: int = 10) -> DataFrame:
    """A row of metrics for each named set: the labels kept are scanned from ``train``, then all sets are scored together.

    ``logit`` takes the names of the text's and the label's column and gives the model's score.
    """
    kept = [r["label"] for r in top_labels(label_counts(train, key, codes), n_keep, percentage).select("label").collect()]
    each = F.explode(F.array(*[F.lit(x) for x in kept])).alias("label")
    parts = [keep_labels(df, codes, kept, max_labels, text).select(F.lit(name).alias("dataset"), F.col(key).alias("sample"), F.col(text).alias("text"), "labels", each) for name, df in sets.items()]
    long = reduce(DataFrame.unionByName, parts)
    return all_metrics(long.select("dataset", "sample", "label", F.array_contains("labels", F.col("label")).cast("int").alias("y"), logit("text", "label").alias("logit")))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def iterate(spark: SparkSession, seed_path: str, pairs_path: str, out: str, learn: Callable[[DataFrame, int], Models], start: int = 1, end: int = 4, **options) -> list[str]:
    """Iterations from ``start`` up to but without ``end``: learn from the pairs before, then run again.

    ``learn`` takes the pairs and the iteration's number and returns the models. An iteration
    whose pairs exist is passed over, so a broken run goes on where it stopped.
    """
    made = []
    for k in range(start, end):
        folder = f"{out}/iteration_{k}"
        if not exists(spark, f"{folder}/dpo/_SUCCESS"):
            supervised_run(spark, seed_path, folder, learn(spark.read.parquet(pairs_path), k), **options)
        pairs_path = f"{folder}/dpo"
        made.append(pairs_path)
    return made
