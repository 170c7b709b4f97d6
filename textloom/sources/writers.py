"""Writers. Names are plain, so that no folder is taken for a partition by mistake."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_file(df: DataFrame, path: str, file: str = "file") -> None:
    """A folder for each input file."""
    df.write.mode("overwrite").partitionBy(file).parquet(path)


def with_chunk(df: DataFrame, ordinal: str, rows: int = 10_000) -> DataFrame:
    """Adds ``chunk``, the number of the chunk of ``rows`` rows, by ordinals from 0 on."""
    return df.withColumn("chunk", ((F.col(ordinal) - F.col(ordinal) % rows) / rows).cast("int"))


def write_csv_chunks(df: DataFrame, ordinal: str, path: str, rows: int = 10_000) -> None:
    """A file ``chunk_00000.csv`` and so on for each chunk of rows, in their order.

    Each chunk is written by one task, below ``_chunks``; the driver then only moves files to their names.
    """
    work = f"{path.rstrip('/')}/_chunks"
    named = with_chunk(df, ordinal, rows)
    named.withColumn("chunk_name", F.format_string("chunk_%05d", "chunk")).drop("chunk").repartition("chunk_name").sortWithinPartitions("chunk_name", ordinal).write.mode("overwrite").partitionBy("chunk_name").csv(work, header=True, escape='"')
    spark = df.sparkSession
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(work).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(of(work)):
        name = folder.getPath().getName()
        if name.startswith("chunk_name="):
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            target = of(f"{path.rstrip('/')}/{name.removeprefix('chunk_name=')}.csv")
            fs.delete(target, False)
            fs.rename(parts[0], target)
    fs.delete(of(work), True)


def write_counted(df: DataFrame, path: str) -> int:
    """Writes a table and returns how many rows that were, without another pass."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def copy_seeds(spark: SparkSession, private: str, public: str, out: str, model: str, size: int) -> dict[str, str]:
    """Copies both seeds into a folder of a run, named by model and size; the copies' paths."""
    folder = f"{out.rstrip('/')}/model_{model.replace('/', '-')}_size_{size}"
    paths = {"private": f"{folder}/private_seed", "public": f"{folder}/public_seed"}
    write_table(spark.read.parquet(private), paths["private"])
    write_table(spark.read.parquet(public), paths["public"])
    return paths


def write_label_mapping(labels: DataFrame, percentage: float | None, path: str) -> None:
    """The labels kept and the percentage, as one JSON object."""
    row = labels.agg(F.sort_array(F.collect_list("label")).alias("filtered_labels")).withColumn("label_filter_percentage", F.lit(percentage).cast("double"))
    row.coalesce(1).write.mode("overwrite").json(path)
