"""The greedy choice of spans against a plain fold."""

import random
import time

import numpy as np
import pytest

from textloom.operators import keywords, overlaps

SCHEMA = "k string, start int, end int, term string, n_term int"


def greedy(rows):
    """Rows (start, end, n, term), best first, each unless a chosen one has one of its tokens."""
    taken, out = set(), set()
    for start, end, n, term in sorted(rows, key=lambda r: (r[0] - r[1], r[0], r[2], r[3])):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            out.add((start, end, term))
    return out


def random_rows(rnd, n, tokens, longest):
    starts = [rnd.randint(0, tokens) for _ in range(n)]
    return [(s, s + rnd.randint(1, longest), rnd.randint(1, 3), rnd.choice("abc")) for s in starts]


@pytest.mark.parametrize("records", ["3", "10000"])
def test_choice(spark, records):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    rnd = random.Random(6)
    rows = {k: random_rows(rnd, rnd.choice([0, 1, 5, 60]), rnd.choice([3, 30, 10**6]), rnd.choice([1, 5, 12])) for k in [None, "", *(f"k{i}" for i in range(25))]}
    df = spark.createDataFrame([(k, s, e, t, n) for k, own in rows.items() for s, e, n, t in own + own[:3]], SCHEMA).repartition(3)
    try:
        got = keywords.resolve_overlaps(df, "k").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k, own in rows.items():
        assert {(r["start"], r["end"], r["match"]) for r in got if r["k"] == k} == greedy(own), k
    assert len(got) == sum(len(greedy(own)) for own in rows.values())
    assert keywords.resolve_overlaps(df.limit(0), "k").count() == 0


def test_empty_spans_and_other_key_types(spark):
    df = spark.createDataFrame([(1, 3, 3, "x", 1), (1, 2, 4, "y", 1), (2, 5, 4, "z", 1)], SCHEMA.replace("k string", "k long"))
    assert [tuple(r) for r in keywords.resolve_overlaps(df, "k").collect()] == [(1, 2, 4, "y")]


def test_long_texts_without_marks_take_linear_time():
    """100,000 tokens with spans of all lengths at each, as one group."""
    start = np.repeat(np.arange(100_000), 5)
    end = start + np.tile(np.arange(1, 6), 100_000)
    began = time.time()
    chosen = overlaps.free_of_overlaps(np.zeros(len(start), int), start, end)
    assert time.time() - began < 20
    assert (end - start)[chosen].tolist() == [5] * 20_000 and start[chosen].tolist() == list(range(0, 100_000, 5))
