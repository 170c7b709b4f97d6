"""Sentence boundaries from a model that is trained on the texts."""

import random

import pytest

from textloom.operators import keywords, sentences


@pytest.fixture(scope="module")
def trained(spark):
    rnd = random.Random(1)
    nouns = ["patient", "report", "dose", "ward", "result", "visit", "scan", "plan"]
    said = lambda: f"{rnd.choice(['The', 'The', 'A'])} {rnd.choice(nouns)} was {rnd.choice(['seen', 'read', 'given'])} by Dr. {rnd.choice(['Smith', 'Jones', 'Lee'])}, approx. {rnd.randint(1, 9)}.5 mg, near the {rnd.choice(nouns)}."
    texts = [" ".join(said() for _ in range(6)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "k long, text string")
    return docs, sentences.train_sentences(docs, "text").cache()


def test_the_model_is_a_table(trained):
    rows = {(r["kind"], r["first"]) for r in trained[1].collect()}
    assert {("abbreviation", "dr"), ("abbreviation", "approx"), ("starter", "the")} <= rows
    assert not {("abbreviation", w) for w in ("patient", "report", "dose", "ward", "result", "visit", "scan", "plan")} & rows


def test_boundaries(spark, trained):
    docs, model = trained
    learnt = sentences.SentenceModel.of(model)
    text = "Seen by Dr. Smith. The dose was approx. 3.5 mg. A report by J. Lee came! Was it 12. mai? Done\nend… The end"
    want = ["Seen by Dr. Smith.", "The dose was approx. 3.5 mg.", "A report by J. Lee came!", "Was it 12. mai?", "Done", "end…", "The end"]
    assert learnt.sentences(text) == want and learnt.sentences(None) == learnt.sentences(" \n ") == []
    assert "".join(learnt.sentences(text)).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    tagger = sentences.TrainedTagger(model=learnt)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string")
    assert {r["k"]: r["s"] for r in df.select("k", tagger.sentences(df["text"]).alias("s")).collect()} == {1: want, 2: [], 3: []}
    spans = {r["span"] for r in keywords.candidate_spans(df, "k", "text", tagger=tagger).collect()}
    assert "Dr . Smith" in spans and not any("Smith . The" in s for s in spans)
    with pytest.raises(ValueError, match="more than 1 "):
        sentences.SentenceModel.of(model, most=1)


def test_no_texts_no_model(spark):
    assert sentences.train_sentences(spark.createDataFrame([(None,)], "text string"), "text").count() == 0
