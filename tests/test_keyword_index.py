"""The stored index of terms, and tokens normalised once."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text, normalize_tokens
from textloom.operators import keywords


def pairs(df):
    return {(r["text"], r["term"], r["n_text"], r["n_term"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.mark.parametrize("measure", ["jaccard", "cosine"])
def test_written_and_opened(spark, tmp_path, monkeypatch, measure):
    monkeypatch.setattr(keywords, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(keywords, "small", lambda df, n: df)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))
    terms = spark.createDataFrame([(word(),) for _ in range(150)] + [(None,), ("",)], "u string")
    texts = spark.createDataFrame([(word(),) for _ in range(200)] + [(None,), ("",)], "t string")
    index = keywords.term_index(terms, "u")
    path = str(tmp_path / "index it's")
    keywords.write_term_index(index, path, 0.6, measure, buckets=5)
    opened = keywords.open_term_index(spark, path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = keywords.fuzzy_match(texts, "t", opened, 0.7, measure)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Both tables of the index are read by buckets, and no exchange stands between them and their joins.
        lines = plan.splitlines()
        for at in [i for i, line in enumerate(lines) if "textloom_index" in line]:
            assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in lines[at - 3 : at])
        assert sum("textloom_index" in line for line in lines) == 2
        assert pairs(found) == pairs(keywords.fuzzy_match(texts, "t", index, 0.7, measure)) != set()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="serves"):
        keywords.fuzzy_match(texts, "t", opened, 0.5, measure)


def test_extraction_by_a_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Le patient a une hypertension artérielle. Diabete de type"), (2, None), (3, "")], "k long, text string")
    terms = spark.createDataFrame([("Hypertension artérielle",), ("diabète",)], "t string")
    index = keywords.write_term_index(keywords.term_index(terms, "t"), str(tmp_path / "i"), buckets=3)
    got = {r["k"]: r["keywords"] for r in keywords.extract_keywords(docs, "k", "text", index, "t").collect()}
    assert got == {1: "hypertension arterielle, diabete", 2: "", 3: ""}
    none = keywords.extract_keywords(docs, "k", "text", terms.limit(0), "t").collect()
    assert {r["keywords"] for r in none} == {""} and len(none) == 3


def test_tokens_are_normalised_as_texts(spark):
    rnd = random.Random(9)
    pieces = ["É", "12", "…", "℀", "-", "ab", "œ", " ", "\u0001", "\n", "½", "𝐀b", "'"]
    rows = [([("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 3)))) for _ in range(rnd.randint(1, 6))],) for _ in range(200)]
    df = spark.createDataFrame(rows, "t array<string>")
    both = df.select(normalize_tokens("t").alias("a"), F.transform("t", lambda t: normalize_text(t)).alias("b"), "t").collect()
    for r in both:
        assert r["a"] == r["b"], r["t"]


def test_normal_spans_are_candidate_spans(spark):
    docs = spark.createDataFrame([(1, "L’état n’est 12 mg… pas, ½ Éléphant rose. Autre ligne\nici"), (2, None)], "k long, text string")
    whole = {(r["start"], r["end"], r["n"]) for r in keywords.candidate_spans(docs, "k", "text").withColumn("n", normalize_text("span")).collect() if 4 <= len(r["n"]) <= 12}
    assert {(r["start"], r["end"], r["normal"]) for r in keywords.normal_spans(docs, "k", "text", 4, 12).collect()} == whole
