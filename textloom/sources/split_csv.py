"""CSV files with line breaks in quoted fields, read in byte ranges.

Whether a line begins a record depends on all quotes before it. A first pass counts the quotes of
each byte range; a running sum over the ranges of a file says whether a range begins inside a quoted
field; and a second pass joins lines to records within each range. Only records that cross from
one range into others are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.ordering import BROADCAST_ROWS, cut, small

QUOTE = '"'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): lines with the byte range that they begin in, and their order there."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line): each line's number in its file, from 0 on, by the lines of the byte ranges before; the same for any ranges."""
    lines = lines_of(spark, path)
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    starts = small(starts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first", "before"), starts.count())
    met = lines.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return met.select("file", (F.col("before") + F.col("at") - F.col("first")).alias("number"), "line")


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, owner, crossed): whether a range begins inside quotes, the range where that record began, and whether a record crosses either end."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    sums = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"), F.max(quotes % 2).alias("turns"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    opens = ((F.col("odd") == 1) != F.col("inside")) & (~F.col("inside") | (F.col("turns") == 1))
    owner = F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)
    return states.select("file", "block", "inside", F.when(F.col("inside"), owner).alias("owner"), (opens | F.col("inside")).alias("crossed"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, inside, owner, line) in order -> (file, owner, block, first, record).

    ``owner`` is null for records within their range; for parts of others it is where those began.
    """
    names = ["file", "owner", "block", "first", "record"]
    key, waiting, inside, first = None, [], False, True
    first_part = None  # where the waiting record began, if before this range

    def one(record: str, whole: bool) -> pa.RecordBatch:
        file, block = key
        mine = None if whole else block if first_part is None else first_part
        return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([mine], pa.int64()), pa.array([block], pa.int64()), pa.array([first and block == 0]), pa.array([record], pa.string())], names)

    for batch in batches:
        files, blocks = batch.column(0), batch.column(1).to_numpy()
        coded = files.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (coded[1:] != coded[:-1]), [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            here = (files[lo].as_py(), int(blocks[lo]))
            if here != key:
                if waiting:
                    yield one("\n".join(waiting), False)
                key, waiting, first = here, [], True
                inside, first_part = batch.column(2)[lo].as_py(), batch.column(3)[lo].as_py()
            lines = batch.column(4).slice(lo, hi - lo)
            turns = (pc.count_substring(lines, QUOTE).to_numpy() & 1).astype(bool)
            after = np.logical_xor.accumulate(np.concatenate([[inside], turns]))
            inside = bool(after[-1])
            ends = np.flatnonzero(~after[1:]) + 1  # a record ends with each line that leaves no quote open
            if not len(ends):
                waiting += lines.to_pylist()
                continue
            start = int(ends[0])
            if waiting or first_part is not None:
                yield one("\n".join([*waiting, *lines.slice(0, start).to_pylist()]), first_part is None)
                first, waiting, first_part = False, [], None
                offsets = ends
            else:
                offsets = np.concatenate([[0], ends])
            if len(offsets) > 1:
                own = lines.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
                lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), own)
                n = len(lists)
                marks = np.zeros(n, bool)
                marks[0], first = first and key[1] == 0, False
                yield pa.RecordBatch.from_arrays([files.slice(lo, 1).take(pa.array(np.zeros(n, np.int64))), pa.nulls(n, pa.int64()), pa.array(np.full(n, key[1])), pa.array(marks), pc.binary_join(lists, "\n")], names)
            waiting = lines.slice(int(ends[-1])).to_pylist()
    if waiting:
        yield one("\n".join(waiting), False)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of CSV files but for the first of each file, its header; a carriage return at the end goes.

    A quote may stand only around a field or doubled within one. An unclosed quote makes the rest of
    its file one record. Files are split as Spark splits lines of text. The states of the ranges,
    one row each, are broadcast if they are few enough; else lines are sorted again after the join.
    """
    lines = lines_of(spark, path)
    states = cut(block_states(lines))
    few = states.count() <= BROADCAST_ROWS

    def pieces(chosen: DataFrame) -> DataFrame:
        named = chosen.withColumnsRenamed({"file": "_file", "block": "_block"})
        met = lines.join(F.broadcast(named) if few else named, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
        met = met if few else met.sortWithinPartitions("file", "block", "at")
        return met.select("file", "block", "inside", "owner", "line").mapInArrow(_records, "file string, owner bigint, block bigint, first boolean, record string")

    whole = pieces(states).filter("owner IS NULL").select("first", "record")
    parts = pieces(states.filter("crossed")).filter("owner IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("block", "record")))
    crossing = parts.groupBy("file", "owner").agg(F.max("first").alias("first"), F.array_join(F.transform(ordered, lambda x: x["record"]), "\n").alias("record"))
    records = whole.unionByName(crossing.select("first", "record")).filter("NOT first")
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def csv_fields(record: Column, names: list[str], separator: str = ",") -> Column:
    """A struct of the record's fields by position, all strings."""
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    return F.from_csv(record, schema, {"sep": separator, "escape": QUOTE, "quote": QUOTE, "multiLine": "true"})


def read_split_csv(spark: SparkSession, path: str, names: list[str], separator: str = ",") -> DataFrame:
    """The columns ``names``, all strings, of CSV files with a header each; rows of one large file come from many tasks."""
    fields = csv_fields(F.col("record"), names, separator)
    return csv_records(spark, path).select(fields.alias("f")).select("f.*")
