"""Ordinals, exact samples by hash, and lineage cuts, without a task that sees all rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and holds at most so many rows.
BROADCAST_ROWS = 20_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, notebooks) gets a folder of its own; on a
    cluster, executors would each write to a disk that no other sees, so there it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def throwaway(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_table(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: smaller where rows are wide, read by column, and ``discard`` can delete it."""
    path = throwaway(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, what a finished write or query has shuffled is deleted at once, not when the driver collects garbage; the setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut_table`` wrote for these frames, once nothing reads them any more."""
    for table in tables:
        if path := getattr(table, "cut_path", None):
            _delete(table.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, is within ``bound``; else as it is."""
    return F.broadcast(df) if rows <= bound else df


def ordinal_within(df: DataFrame, group: str, order: list[Column], extra: list[str], partitions: int | None = None, name: str = "ordinal") -> DataFrame:
    """The group, the columns ``extra``, and ``name``: the 1-based rank of each row in its group, without one task per group.

    Rows are range-partitioned on (group, order), numbered in each partition, and the counts of
    (partition, group) turn the numbers into ranks; the table of counts has at most
    partitions + groups rows. The columns travel in a struct, so they may have any names; one
    called ``name`` is replaced.
    """
    n = partitions or max(1, shuffle_partitions(df.sparkSession))
    kept = [c for c in dict.fromkeys([group, *extra]) if c != name]
    key = F.col(group).asc_nulls_last()
    ranged = df.select(*dict.fromkeys([group, *extra])).repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    packed = ranged.select(F.struct(*kept).alias("row"), F.col(group).alias("group"), F.monotonically_increasing_id().alias("at"))
    numbered = cut_table(packed.withColumn("part", F.shiftright("at", 33)))
    counts = numbered.groupBy("part", "group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    starts = small(starts.select(F.col("part").alias("_part"), F.col("group").alias("_group"), "first", "before"), starts.count())
    joined = numbered.join(starts, (F.col("part") == F.col("_part")) & F.col("group").eqNullSafe(F.col("_group")))
    return joined.select(*[F.col("row")[c].alias(c) for c in kept], (F.col("at") - F.col("first") + F.col("before") + 1).alias(name))


def with_ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """Adds the 1-based rank of each row in the order, which should be total; a column called ``name`` is replaced."""
    one = "_everything"
    while one in df.columns:
        one = "_" + one
    ranked = ordinal_within(df.withColumn(one, F.lit(1)), one, list(order), df.columns, name=name)
    return ranked.select(*[c for c in df.columns if c != name], name)


def hash_order(key: Column, seed: int) -> Column:
    """A text whose order is a random order of the keys, the same in any engine with md5."""
    return F.md5(F.concat_ws("~", key.cast("string"), F.lit(str(seed))))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int) -> Column:
    """A condition that holds for exactly the ``n`` first rows of ``df`` in hash order (keys are unique).

    Counts of 65,536 hash prefixes say in which of them the n-th row is, and only its rows are put
    in order; the condition itself is a comparison that needs no shuffle.
    """
    digest = hash_order(F.col(key), seed)
    prefixes = df.groupBy(F.substring(digest, 1, 4).alias("p")).count().toPandas().sort_values("p")
    ends = prefixes["count"].cumsum().to_numpy()
    if n <= 0 or not len(ends):
        return F.lit(False)
    if n >= ends[-1]:
        return F.lit(True)
    at = int((ends < n).sum())
    left = n - (int(ends[at - 1]) if at else 0)
    inside = df.filter(F.substring(digest, 1, 4) == prefixes["p"].iloc[at]).select(digest.alias("d"), F.col(key).alias("k")).orderBy("d", "k").limit(left)
    last = inside.agg(F.max(F.struct("d", "k")).alias("m")).first()["m"]
    return (digest < last["d"]) | ((digest == last["d"]) & (F.col(key) <= last["k"]))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer."""
    return df.filter(first_by_hash(df, key, n, seed))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """All rows in a random order, which is kept as a column because files keep none."""
    return with_ordinal(df, hash_order(F.col(key), seed), F.col(key), name=name)


def train_test_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ceil(share * rows) in hash order are test, the others train."""
    n = df.count()
    return df.withColumn("split", F.when(first_by_hash(df, key, ceil(round(share * n, 9)), seed), "test").otherwise("train"))


def head_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first ``n`` rows by their ordinals from 0 on; all for a negative ``n``."""
    return df if n < 0 else df.filter(F.col(ordinal) < n)
