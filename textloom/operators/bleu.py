"""Sentence BLEU in the row: clipped counts of hashed n-grams, for many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.functions.text import bleu_tokens

#: Rows run side by side until they have so many tokens.
RUN_TOKENS = 1 << 20
_FACTOR, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _counted(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, n-gram) as one number, and how often each is there."""
    return np.unique(row.astype(np.uint64) << np.uint64(44) | grams >> np.uint64(20), return_counts=True)


def _side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows, each one's row, and the tokens from it to its row's end."""
    ends = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    return column.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), row, ends[1:][row] - ends[0] - np.arange(ends[-1] - ends[0])


def _scores(candidate: pa.Array, reference: pa.Array, orders: int) -> np.ndarray:
    n = len(candidate)
    sides = [_side(c) for c in (candidate, reference)]
    n_h, n_r = (np.bincount(row, minlength=n) for _, row, _ in sides)
    grams = [np.zeros(len(tokens), np.uint64) for tokens, *_ in sides]
    log_sum, some = np.zeros(n), np.zeros(n, bool)
    for k in range(orders):
        found = []
        for g, (tokens, row, left) in zip(grams, sides, strict=True):
            there = left > k
            ahead = np.append(tokens, np.zeros(orders, np.uint64))[k : k + len(tokens)]
            g[there] = (g[there] * _FACTOR + ahead[there]) * _NEXT
            g[there] ^= g[there] >> np.uint64(29)
            found.append(_counted(g[there], row[there]))
        (a, c_a), (b, c_b) = found
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        matches = np.bincount((a[i] >> np.uint64(44)).astype(np.int64), np.minimum(c_a[i], c_b[j]), minlength=n)
        if k == 0:
            some = matches > 0
        log_sum += np.log(np.where(matches > 0, matches, 0.1) / np.maximum(n_h - k, 1)) / orders
    penalty = np.where(n_h > n_r, 1.0, np.exp(1 - n_r / np.maximum(n_h, 1)))
    return np.where(some, penalty * np.exp(log_sum), 0.0)


def sentence_bleu(df: DataFrame, key: str, candidate: str, reference: str, into: str = "bleu_score", orders: int = 4) -> DataFrame:
    """(key, score): BLEU with equal weights, brevity penalty, and 0.1 in place of a count of no matches.

    Without a common word, or with an empty or null candidate, the score is 0. Words are hashed by
    Spark; n-grams of whole batches are then counted together, and nothing is shuffled.
    """
    hashed = lambda c: F.transform(bleu_tokens(c), lambda t: F.xxhash64(t))
    rows = df.select(F.col(key), hashed(candidate).alias("h"), hashed(reference).alias("r"))
    schema = StructType([df.select(key).schema.fields[0], StructField(into, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.cumsum(sum(pa.compute.list_value_length(c).to_numpy() for c in batch.columns[1:]))
            lo = 0
            while lo < batch.num_rows:
                done = tokens[lo - 1] if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(tokens, done + RUN_TOKENS, side="right"))), lo + (1 << 15), batch.num_rows)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(part.column(1), part.column(2), orders))], schema.names)
                lo = hi

    return rows.mapInArrow(score, schema)
