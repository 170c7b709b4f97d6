"""What grows with the input: rows that move, and work on each row."""

import re

from textloom.operators import codes, keywords, plugins, sentences


def plan(df):
    """The physical plan, top first, one node in a line."""
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def exchanges(df):
    return [line for line in plan(df) if re.search(r"\bExchange\b", line)]


def test_spans_move_as_texts(spark):
    """Tokens don't move: the only exchange has texts, and all that makes more of them is above it."""
    spans = keywords.candidate_spans(spark.createDataFrame([(1, "A red kettle. Two lanterns")], "k long, text string"), "k", "text")
    lines = plan(spans)
    places = [i for i, line in enumerate(lines) if re.search(r"\bExchange\b", line)]
    assert len(places) == 1
    assert max(i for i, line in enumerate(lines) if "Generate" in line) < places[0]
    assert {(r["start"], r["end"], r["span"]) for r in spans.collect()} == {(1, 2, "red"), (1, 3, "red kettle"), (1, 4, "red kettle ."), (2, 3, "kettle"), (2, 4, "kettle ."), (4, 5, "Two"), (4, 6, "Two lanterns"), (5, 6, "lanterns")}


def test_spans_that_no_term_is_like_are_not_kept(spark):
    """Long spans of several words have too many grams at their spaces, unless terms have such grams."""
    docs = spark.createDataFrame([(1, "kettles lantern garden windows")], "k long, text string")
    every = keywords.normal_spans(docs, "k", "text", 1, 40)
    kept = lambda *crossing: {r["normal"] for r in keywords.normal_spans(docs, "k", "text", 1, 40, share=0.8, crossing=crossing).collect()}
    assert {r["normal"] for r in every.collect()} > kept() == {"kettles", "lantern", "garden", "windows"}
    assert "garden windows" not in kept() and "garden windows" in kept("en ", "n w", " wi")


def test_repeated_texts_are_put_together_before_they_move(spark):
    index = keywords.term_index(spark.createDataFrame([("kettle",)], "t string"), "t")
    found = keywords.fuzzy_match(spark.createDataFrame([("kettles",)] * 50, "t string"), "t", keywords.build_index(index))
    lines = plan(found)
    lowest = [i for i, line in enumerate(lines) if re.search(r"\bExchange\b", line) and "text" in line][-1]
    assert any("HashAggregate" in line for line in lines[lowest + 1 : lowest + 3])
    assert [(r["text"], r["term"]) for r in found.collect()] == [("kettles", "kettle")]


def test_matches_of_spans_do_not_move_again(spark):
    spans = keywords.candidate_spans(spark.createDataFrame([(1, "A red kettle")], "k long, text string"), "k", "text")
    chosen = keywords.resolve_overlaps(spans.withColumn("n_term", spans["end"]).withColumnRenamed("span", "term"), "k")
    assert len(exchanges(chosen)) == 1
    assert [(r["start"], r["end"], r["match"]) for r in chosen.collect()] == [(1, 3, "red kettle")]


def test_samples_of_associated_codes_are_read_once(spark):
    samples = spark.range(3).selectExpr("id AS k", "'a' AS p", "'b c' AS o")
    out = codes.associated_code_sets(samples, "k", "p", "o", spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", ["z"])], "code string, terms array<string>"), 2, 2, 42)
    assert sum(bool(re.search(r"\bRange\b", line)) for line in plan(out)) == 1 and not any("Window" in line for line in plan(out))
    assert {(r["sample"], r["codes"].split()[0], len(r["codes"].split()) - r["n_codes"]) for r in out.collect()} == {(i, "a", 1) for i in range(3)}


def test_windows_are_embedded_once(spark):
    docs = spark.createDataFrame([("a b b c", "b c d")], "x string, y string")
    out = plugins.add_similarity(docs, "x", "y", plugins.HashEmbedder(), plugins.WordTokenizer())
    assert out._jdf.queryExecution().analyzed().toString().count("xxhash64") == 3  # both texts and the windows
    vector = docs.select(plugins.HashEmbedder(8).embed(docs["x"]).alias("v")).first()["v"]
    assert sum(vector) == 4 and max(vector) >= 2 and len(vector) == 8


def test_only_words_after_periods_are_counted_in_pairs(spark):
    docs = spark.createDataFrame([("Seen by Dr. Smith and Dr. Lee",), (None,)], "t string")
    rows = [tuple(r) for r in sentences.neighbours(docs, "t").select("type", "before", "dotted").collect()]
    assert rows == [("seen", "first", None), ("by", "word", None), ("dr", "word", None), ("smith", "period", "dr"), ("and", "word", None), ("dr", "word", None), ("lee", "period", "dr")]


def test_shared_grams_are_counted_once(spark):
    index = keywords.build_index(keywords.term_index(spark.createDataFrame([("kettle",)], "t string"), "t"))
    found = keywords.fuzzy_match(spark.createDataFrame([("kettles",)], "t string"), "t", index)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert [(r["text"], r["term"], r["similarity"]) for r in found.collect()] == [("kettles", "kettle", 0.8)]


def test_each_distinct_term_is_normalised_once(spark):
    """Only what has been grouped is normalised; Spark takes two distincts in a row for one, on every row."""
    terms = spark.createDataFrame([("Kettle",)] * 50 + [("kettle",), (None,), ("ab",)], "t string")
    index = keywords.term_index(terms, "t")
    lines = plan(index)
    normalised = [i for i, line in enumerate(lines) if "translate(" in line]
    assert normalised and all(sum("HashAggregate" in line for line in lines[i + 1 :]) >= 2 for i in normalised)
    assert [(r["term"], r["n_term"]) for r in index.collect()] == [("kettle", 4)]


def test_candidates_differ_in_few_bits(spark):
    """What shares its rarest gram and no more isn't compared; what is like enough is found by every measure, whether or not the index has bits."""
    index = keywords.build_index(keywords.term_index(spark.createDataFrame([("kettlezq",), ("marblezq",)], "t string"), "t"), 0.5)
    texts = spark.createDataFrame([("kettlezq",), ("kettlesz",), ("gardenzq",)], "t string")
    found = keywords.fuzzy_match(texts, "t", index, 0.5)
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()
    plain = keywords.TermIndex(index.probes.withColumn("bits", keywords.F.lit(None).cast("long")), index.counts, index.measure, index.threshold)
    want = {("kettlezq", "kettlezq"), ("kettlesz", "kettlezq")}
    assert {(r["text"], r["term"]) for r in found.collect()} == {(r["text"], r["term"]) for r in keywords.fuzzy_match(texts, "t", plain, 0.5).collect()} == want


def test_a_large_index_does_not_move_to_few_texts(spark, monkeypatch):
    """Only where neither side is small does the index move, by gram and size."""
    index = keywords.build_index(keywords.term_index(spark.createDataFrame([("kettle",)] * 3 + [("lantern",)], "t string"), "t"))
    monkeypatch.setattr(keywords, "_bounds", lambda index, f=keywords._bounds: (*f(index)[:2], 1 << 40))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for least in (keywords.BROADCAST_BYTES, 0):
            monkeypatch.setattr(keywords, "BROADCAST_BYTES", least)
            found = keywords.fuzzy_match(spark.createDataFrame([("kettles",), ("lanterns",)], "t string"), "t", index)
            assert any("size#" in line for line in exchanges(found)) == (least == 0)
            assert {(r["text"], r["term"]) for r in found.collect()} == {("kettles", "kettle"), ("lanterns", "lantern")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
