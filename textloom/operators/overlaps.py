"""A greedy choice of spans that share no token, in time that grows with the number of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def free_of_overlaps(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the spans are chosen: longer ones first, then earlier ones, each if no chosen one of its group shares a token.

    Spans are sorted by group and start, and no two of a group have both ends in common. All groups
    are laid out on one line of stretches between span ends, so each length takes one pass: what
    longer spans hold is a running sum, and among spans of one length the next is the first to begin
    at or after the end of the last.
    """
    chosen = np.zeros(len(group), bool)
    if not len(group):
        return chosen
    _, number = np.unique(group, return_inverse=True)
    width = int(end.max()) - int(start.min()) + 1
    place = lambda x: number.astype(np.int64) * width + (x - int(start.min()))
    ends = np.unique(np.concatenate([place(start), place(end)]))
    left, right = np.searchsorted(ends, place(start)), np.searchsorted(ends, place(end))
    held = np.zeros(len(ends) + 1, np.int64)  # changes, from stretch to stretch, in how many chosen spans hold it
    size = end - start
    order = np.argsort(-size, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], size[order][1:] != size[order][:-1], [True]]))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = order[lo:hi]
        before = np.concatenate([[0], np.cumsum(np.cumsum(held[:-1]))])
        own = own[before[right[own]] == before[left[own]]]
        last, kept = -1, []
        for i, a, b in zip(own.tolist(), left[own].tolist(), right[own].tolist(), strict=True):
            if a >= last:
                kept.append(i)
                last = b
        chosen[kept] = True
        np.add.at(held, left[kept], 1)
        np.add.at(held, right[kept], -1)
    return chosen


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, end, match), sorted, to those that are chosen. The rows of a batch's last key wait for the next batch."""
    waiting: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        group, start, end = changes(table["_key"]), table["start"].to_numpy(), table["end"].to_numpy()
        yield from table.filter(pa.array(free_of_overlaps(group, start, end))).to_batches()

    def changes(keys: pa.ChunkedArray) -> np.ndarray:
        codes = pc.fill_null(keys.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        return np.cumsum(np.concatenate([[0], codes[1:] != codes[:-1]]))

    for batch in batches:
        if not len(batch):
            continue
        codes = changes(pa.chunked_array([batch.column(0)]))
        first = int(np.searchsorted(codes, codes[-1]))  # where the last key begins
        if waiting and (first or batch.column(0)[0] != waiting[-1].column(0)[0]):
            head = 0 if batch.column(0)[0] != waiting[-1].column(0)[0] else int(np.searchsorted(codes, 1))
            yield from done([*waiting, batch.slice(0, head)])
            waiting, batch, first = [], batch.slice(head), first - head
        if first > 0:
            yield from done([batch.slice(0, first)])
        waiting.append(batch.slice(max(first, 0)))
    if waiting:
        yield from done(waiting)


def resolve_overlaps(matches: DataFrame, key: str) -> DataFrame:
    """(key, start, end, match): a greedy choice of matches that share no token.

    Longer spans first, then earlier ones, then terms with fewer grams (``n_term``), then by ``term``.
    Of matches with the same ends only the best takes part. The matches of a key go through one task
    as a sorted stream, which holds those of one key and one batch at a time. A null key is a key.
    Matches that are dealt out by key already, as those of ``candidate_spans`` are, don't move.
    """
    spans = matches.filter("start < end").select(F.col(key).alias("_key"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n_term", F.col("term").alias("match"))
    order = Window.partitionBy("_key").orderBy("start", "end", "n_term", "match")
    before = spans.withColumn("_start", F.lag("start").over(order)).withColumn("_end", F.lag("end").over(order))
    best = before.filter("_start IS NULL OR _start <> start OR _end <> end")
    rows = best.select("_key", "start", "end", "match")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_chosen, schema).withColumnRenamed("_key", key)
