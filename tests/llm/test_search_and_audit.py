"""Lexical search, filter audit and bit-sliced search against plain Python."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bit_sliced, filter_audit, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
last = lambda x: (x is None, x)


# Lexical search


def plain_search(docs, items, top=20):
    counts = [(key, Counter(TERM.findall(lowered(t)))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in TERM.findall(lowered(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, last(key), key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("bound", [20_000, 0])
def test_search(spark, monkeypatch, bound):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", bound)
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Der", "der", "ÉTÉ", "été", "x1", "a_b", "don't", "猫", "İ", "rare%d" % rnd.randint(0, 20)])
    text = lambda n: rnd.choice([" ", "-", "\n", "\x00"]).join(word() for _ in range(rnd.randint(0, n)))
    docs = [(i, text(40)) for i in range(60)] + [(70, None), (71, ""), (72, "..."), (None, text(9)), (73, "der " * 3000), (5, "été x1"), (5, "été x1")]
    items = [(i, text(12)) for i in range(8)] + [(9, None), (10, ""), (11, "nowhere"), (12, "x1 x1 X1"), (12, "x1 x1 X1"), (None, "rare3 été")]
    d = spark.createDataFrame([(*r, "t", 1) for r in docs], "doc_id long, text string, term string, score int").repartition(3)
    out = lexical.search_documents(d, spark.createDataFrame(items, "item_id long, text string"), top=7).select("item", "rank", "key", "score").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(plain_search(docs, items, 7), key=repr)


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search_documents(docs.limit(0), items).count() == 0
    assert lexical.search_documents(docs, items.limit(0)).count() == 0
    assert lexical.search_documents(docs, items).count() == 1


def test_terms_are_counted_whole(spark):
    """Words that a polynomial hash modulo 2**64 can't tell apart are different terms."""
    odd = "a"
    while len(odd) < 2048:
        odd += odd.translate(str.maketrans("ab", "ba"))
    other = odd.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, f"{odd} {other} {odd}"), (2, other)], "doc_id long, text string")
    got = {(r["key"], r["term"]): (r["tf"], r["n"]) for r in lexical.index_documents(d).collect()}
    assert got == {(1, odd): (2, 3), (1, other): (1, 3), (2, other): (1, 1)}


def test_a_written_index_is_searched_by_bucket(spark, tmp_path):
    d = spark.createDataFrame([(i, f"word{i % 7} common") for i in range(50)], "doc_id long, text string")
    lexical.index_documents(d).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = lexical.search(index, spark.createDataFrame([(1, "word3")], "item_id long, text string"), top=3)
    assert [r["key"] for r in found.orderBy("rank").collect()] == [3, 10, 17]
    assert "In(bucket" in found._jdf.queryExecution().toString() or "EqualTo(bucket" in found._jdf.queryExecution().toString()


# Filter audit


def plain_audit(docs, labels):
    first, fails, good, bad = {}, [], {}, {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    for key, q, t in labels:
        good[key], bad[key] = max(good.get(key, 0), q == 1), max(bad.get(key, 0), t == 1)
    for key, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and key > first[t]}
        fails.append((part or "", {f for f in own if own[f]}, good.get(key, 0) if key is not None else 0, bad.get(key, 0) if key is not None else 0))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, removed_by = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_audit(spark):
    rnd = random.Random(8)
    texts = ["", None, "one two", "LOUD WORDS", " ".join(f"w{i}" for i in range(60)), "again " * 80, " ".join(f"w{i}" for i in range(55)) + " 5%", "\x0b\x1c" + "É " * 60, "Ab" * 40_000]
    docs = [(i, rnd.choice(texts), rnd.choice(["s", "t", None, ""])) for i in range(120)] + [(None, "one two", "s"), (None, "one two", "s"), (3, "twice", "u"), (3, "twice", "u"), (900, "twice", "s")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(90)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (3000, 1, 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, mask int, good int").repartition(5)
    out = filter_audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in out.collect()}
    assert got == plain_audit(docs, labels) and out.count() == 4 * 600


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit_filters(docs, labels.limit(0)).collect()
    assert len(rows) == 600 and {r["good_lost"] for r in rows} == {0}
    assert {r["good_lost"] for r in filter_audit.audit_filters(docs, labels).collect()} == {0, 1}


# Bit-sliced search


def plain_products(rows, every, k):
    ints = [(key, [math.floor(float(x) * 256.0) for x in v]) for key, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (key, q) in enumerate(ints):
        if key is not None and key % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), last(other), other) for j, (other, v) in enumerate(ints) if j != i and len(v) == len(q)))[:k]
            out += [(key, rank, other, -s) for rank, (s, _, other) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "span"), [(1 << 15, 12_800), (16, 8)])
def test_products(spark, monkeypatch, block, span):
    rnd = random.Random(4)
    monkeypatch.setattr(bit_sliced, "BLOCK", block)
    monkeypatch.setattr(bit_sliced, "SPAN", span)
    vector = lambda n: [rnd.choice([rnd.gauss(0, 0.2), 0.0, -0.0, 0.25, 7.5, -1e-9]) for _ in range(n)]
    rows = [(i, vector(6)) for i in range(90)] + [(100 + i, [0.5] * 6) for i in range(40)] + [(200, None), (210, []), (211, []), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (230, [float("nan")] * 6), (240, [float("inf")] + [0.0] * 5), (10, vector(6)), (10, [0.5] * 6), (10, [0.5] * 6), (None, [9.0] * 6), (-10, vector(3)), (250, vector(3)), (251, [-90000.5, 3.0, 1e6])]
    df = spark.createDataFrame([(key, v, 1, "x") for key, v in rows], "vec_id long, embedding array<double>, ordinal int, id string").repartition(4)
    out = bit_sliced.top_products(df, F.col("id") % 10 == 0)
    assert sorted(map(tuple, out.select("query_id", "rank", "id", "score").collect()), key=repr) == plain_products(rows, 10, 5)


def test_products_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bit_sliced.top_products(df, F.col("id") % 50 == 0).count() == 0


def test_slices_add_up():
    rnd = np.random.default_rng(1)
    values = rnd.integers(-300, 900, (1000, 20))
    values[:, 3] = 7
    low, n_bits, maps = bit_sliced.sliced(values)
    block = bit_sliced.Block(1000, low, n_bits, maps.tobytes())
    for query in ([0] * 20, rnd.integers(-260, 260, 20).tolist()):
        found = block.top(query, 1000)
        assert [s for _, s in sorted(found)] == (values @ query).tolist()
        best = sorted(range(1000), key=lambda r: (-int(values[r] @ query), r))
        assert sorted(r for r, _ in block.top(query, 9)) == sorted(best[:9])
        assert best[0] not in {r for r, _ in block.top(query, 9, without=best[0])}
