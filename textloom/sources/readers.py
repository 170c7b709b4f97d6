"""Readers. Schemas are given, not inferred; row order is kept as an ordinal where it matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import base_name, newline_to_space, normalize_text, split_words
from textloom.operators.ordering import with_ordinal
from textloom.sources.split_csv import csv_fields, numbered_lines, read_split_csv


def read_table(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """A Parquet table; ``ordinal`` names a column for the row's place from 0 on, over several files in the order of their paths."""
    df = spark.read.parquet(path)
    if not ordinal:
        return df
    if len(df.inputFiles()) <= 1:
        return df.select("*", F.col("_metadata.row_index").alias(ordinal))
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    ranked = with_ordinal(placed, F.col("_path"), F.col("_index"), name=ordinal)
    return ranked.select(*df.columns, (F.col(ordinal) - 1).alias(ordinal))


def read_pair(spark: SparkSession, private: str, public: str, ordinal: str = "row") -> tuple[DataFrame, DataFrame]:
    return read_table(spark, private, ordinal), read_table(spark, public, ordinal)


def read_folder(spark: SparkSession, folder: str, row: str | None = None) -> DataFrame:
    """All Parquet files of a folder, with ``file``, the name of each row's file without extension, and its place there as ``row``."""
    df = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(folder)
    own = [F.col("_metadata.row_index").alias(row)] if row else []
    return df.select("*", *own, base_name(F.col("_metadata.file_name")).alias("file"))


def read_csv(spark: SparkSession, path: str, columns: list[str], separator: str = ",", line_breaks: bool = True) -> DataFrame:
    """A CSV table with a header, all strings; a missing column is an error.

    With ``line_breaks``, quoted fields may have them; quotes then stand only around fields, or
    doubled in them. Large files are split either way.
    """
    df = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"', sep=separator, inferSchema=False)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return (read_split_csv(spark, path, df.columns, separator) if line_breaks else df).select(*[f"`{c}`" for c in columns])


def sample_lines(spark: SparkSession, path: str, n: int, columns: list[str], separator: str = ",", seed: int = 42) -> DataFrame:
    """``n`` random rows of CSV files without line breaks in fields, or all if there are fewer; the same for the same files, however they are split.

    A line's draw is a hash of its file's name and its number in the file.
    """
    names = spark.read.csv(path, header=True, escape='"', sep=separator, inferSchema=False).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    lines = numbered_lines(spark, path).filter((F.col("number") > 0) & (F.trim("line") != ""))
    drawn = lines.withColumn("draw", F.xxhash64(F.lit(seed), base_name(F.col("file")), F.col("number"))).orderBy("draw", "file", "number").limit(n)
    return drawn.select(csv_fields(F.regexp_replace("line", "\r$", ""), names, separator).alias("f")).select(*[F.col("f")[c].alias(c) for c in columns])


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["dictionary_keys", "code"])


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["diagnostic", "diagnostic_associes"], ";")


def read_notes(spark: SparkSession, path: str, column: str = "input", codes: str | None = None) -> DataFrame:
    """Notes, normalised after line breaks became spaces; with ``codes``, also the array of codes."""
    df = read_csv(spark, path, [column, codes] if codes else [column])
    df = df.withColumn(column, normalize_text(newline_to_space(column)))
    return df.withColumn(codes, split_words(codes)) if codes else df


def read_template(spark: SparkSession, path: str) -> str:
    """A small text file as one string, stripped."""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) from a Parquet table or JSON lines."""
    df = spark.read.schema("word string, n bigint").json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return df.select("word", F.col("n").cast("bigint").alias("n"))


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(term, definition) from a Parquet table or JSON lines; blank terms are left out."""
    df = spark.read.schema("term string, definition string").json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return df.select("term", "definition").filter(F.trim("term") != "")


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The words of a text file, one a line, for wherever function words are an argument."""
    return tuple(sorted({r[0] for r in spark.read.text(path).select(F.lower(F.trim("value"))).filter("trim(value) <> ''").collect()}))
