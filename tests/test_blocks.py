"""Keywords from blocks of token numbers, held against spans as rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks, keywords, plugins

WORDS = ["kettle", "kettles", "Internationalisation", "internationalisations", "garden", "the", "x", "12", ",", ".", "½", "Éléphant", "thé", "of", "lanterns", "z", "'", "ﬁne", "rose"]
TERMS = ["kettle", "internationalisation", "garden", "thé", "lantern", "elephant rose", "x", "fine", "rose", "gardenrose", "lantern garden"]


def texts(n, seed=4):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 30)))) for i in range(n)] + [(n, None), (n + 1, ""), (None, "kettle")]


def by_rows(docs, terms, threshold, measure, tagger=None):
    """Keywords by way of all candidate spans as rows, and of the match that needs no table."""
    index = keywords.build_index(keywords.term_index(terms, "t"), threshold, measure)
    spans = keywords.candidate_spans(docs, "k", "text", tagger=tagger).withColumn("normal", keywords.normalize_text("span"))
    found = keywords.fuzzy_match(spans, "normal", index, threshold, measure).select("text", "term", "n_term")
    kept = keywords.resolve_overlaps(spans.join(found, F.col("normal") == F.col("text")).select("k", "start", "end", "term", "n_term"), "k").collect()
    lists = {}
    for r in sorted(kept, key=lambda r: (r["k"] or 0, r["start"])):
        lists.setdefault(r["k"], {}).setdefault(r["match"])
    return {r["k"]: "" if r["k"] is None else ", ".join(lists.get(r["k"], ())) for r in docs.collect()}


@pytest.mark.parametrize(("measure", "threshold"), [("jaccard", 0.8), ("dice", 0.7), ("cosine", 0.75), ("overlap", 0.9), ("jaccard", 0.4)])
def test_as_spans_in_rows(spark, monkeypatch, measure, threshold):
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 40)  # texts lie in several blocks
    docs, terms = spark.createDataFrame(texts(60), "k long, text string"), spark.createDataFrame([(t,) for t in TERMS], "t string")
    got = keywords.extract_keywords(docs, "k", "text", terms, "t", threshold, measure).collect()
    want = by_rows(docs, terms, threshold, measure)
    assert {r["k"]: r["keywords"] for r in got} == want and len(got) == 63 and len(set(want.values())) > 30


def test_tags_that_depend_on_neighbours(spark):
    class Second(plugins.ClosedClassTagger):
        def tags(self, tokens):
            no = F.lit(False)
            return F.transform(tokens, lambda t, i: F.struct((i % 2 == 0).alias("closed"), no.alias("stop"), no.alias("number"), no.alias("mark")))

    docs, terms = spark.createDataFrame(texts(20), "k long, text string"), spark.createDataFrame([(t,) for t in TERMS], "t string")
    got = {r["k"]: r["keywords"] for r in keywords.extract_keywords(docs, "k", "text", terms, "t", tagger=Second()).collect()}
    assert got == by_rows(docs, terms, 0.8, "jaccard", Second()) and any(got.values())


def test_first_grams_from_a_table(spark):
    """What meets the index is the same as by grouped grams, without grams that no term has."""
    terms = spark.createDataFrame([(t,) for t in ["kettle", "banana bread", "anana", "xx", "aaaaaa"]], "t string")
    index = keywords.build_index(keywords.term_index(terms, "t", min_length=1))
    table = blocks.gram_table(index.probes.select("term", "n_term").distinct())
    said = spark.createDataFrame([(t,) for t in ["kettles", "banana breads", "x", "xx", "aaaaaaa", "zzz", "ananas"]], "t string")
    sides = [{tuple(r) for r in keywords.fuzzy_match(said, "t", index, table=x).collect()} for x in (None, table)]
    assert sides[0] == sides[1] and len(sides[0]) >= 4
    counts = {r["gram"]: r["n"] for r in index.counts.collect()}
    assert dict(zip(table.hashes.tolist(), table.counts.tolist(), strict=True)) == counts


def test_spans_are_no_rows(spark):
    """No span is a row: what moves to the result is a row for each block, of which a word is one item."""
    docs = spark.createDataFrame([(i, "kettle " * 200) for i in range(50)], "k long, text string")
    packed = blocks.token_blocks(docs, "k", "text", plugins.ClosedClassTagger())
    rule = blocks.span_rule(3, 20, 5, 0.0, blocks.least_size("jaccard", 0.8), None)
    said = blocks.span_texts(packed, rule)
    n_blocks = packed.count()
    assert n_blocks <= 50 and said.count() == 3 * n_blocks  # one, two and three kettles
    plan = keywords.extract_keywords(docs, "k", "text", spark.createDataFrame([("kettle",)], "t string"), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"Exchange hashpartitioning\(normal", plan)


def test_meanings_by_a_join(spark, monkeypatch):
    """Where they are too large for a broadcast, a join brings each block its own, with the same keywords."""
    docs, terms = spark.createDataFrame(texts(40), "k long, text string"), spark.createDataFrame([(t,) for t in TERMS], "t string")
    sides = []
    for most in (keywords.MEANT_BYTES, 0):
        monkeypatch.setattr(keywords, "MEANT_BYTES", most)
        sides.append({r["k"]: r["keywords"] for r in keywords.extract_keywords(docs, "k", "text", terms, "t").collect()})
    assert sides[0] == sides[1] and any(sides[0].values())
