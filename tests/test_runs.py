import os

import pytest

from textloom.plans import runs
from textloom.sources import readers, writers
from textloom.streaming import events


@pytest.fixture(scope="module")
def seed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("seed") / "seed.parquet")
    rows = [(f"Write about cats {i}.", "cats, dogs", f"A response about cats number {i}.") for i in range(12)]
    spark.createDataFrame(rows, "instruction string, keywords string, response string").coalesce(1).write.parquet(path)
    return path


def test_supervised_run_and_iterations(spark, seed, tmp_path):
    paths = runs.supervised_run(spark, seed, str(tmp_path / "run"), n_candidates=3, top_n=20)
    scored = spark.read.parquet(paths["scored"])
    assert scored.count() == 12 and {"cumulative_score_3", "bleu_score_1", "overlap_keys_2"} <= set(scored.columns)
    assert spark.read.parquet(paths["sft"]).count() == 20 and spark.read.parquet(paths["dpo"]).count() > 0
    order = {r["rank"]: (r["example_id"], r["candidate_id"]) for r in spark.read.parquet(paths["sorted"]).collect()}
    assert sorted(order) == list(range(1, 37))
    assert {(r["example_id"], r["candidate_id"]) for r in spark.read.parquet(paths["sft"]).collect()} == {order[k] for k in range(1, 21)}
    assert sorted((r["rank"], r["label"]) for r in spark.read.parquet(paths["kto"]).select("rank", "label").collect()) == sorted([(k, True) for k in range(1, 21)] + [(k, False) for k in range(17, 37)])
    held = spark.read.parquet(paths["eval"]).orderBy("rank").collect()
    assert [r["rank"] for r in held] == list(range(1, 21)) and [r["similarity_score"] for r in held] == sorted((r["similarity_score"] for r in held), reverse=True)
    seen = []

    def learn(pairs, k):
        seen.append((k, pairs.count()))
        return runs.Models()

    made = runs.iterate(spark, seed, paths["dpo"], str(tmp_path / "it"), learn, 1, 3, n_candidates=2, top_n=5)
    assert len(made) == 2 and [k for k, _ in seen] == [1, 2]
    runs.iterate(spark, seed, paths["dpo"], str(tmp_path / "it"), learn, 1, 3)
    assert len(seen) == 2  # what exists is passed over


def test_sources(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('dictionary_keys,code\n"a ""q"", b\nc",X1\nd,X2\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_code_dictionary(spark, str(path)).collect()] == [('a "q", b\nc', "X1"), ("d", "X2")]
    with pytest.raises(ValueError, match="diagnostic"):
        readers.read_associations(spark, str(path))
    notes = tmp_path / "n.csv"
    notes.write_text('input,labels\n"Été\nfini",A1  B2\n', encoding="utf-8")
    row = readers.read_notes(spark, str(notes), codes="labels").first()
    assert (row["input"], row["labels"]) == ("ete fini", ["A1", "B2"])
    df = spark.range(25).withColumnRenamed("id", "k")
    writers.write_csv_chunks(df, "k", str(tmp_path / "chunks"), 10)
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk_*.csv")) == [f"chunk_0000{i}.csv" for i in range(3)]
    writers.write_table(df.coalesce(1), str(tmp_path / "folder/one.parquet"))
    assert {r["file"].split("-")[0] for r in readers.read_folder(spark, str(tmp_path / "folder")).select("file").distinct().collect()} == {"part"}
    writers.write_label_mapping(spark.createDataFrame([("b",), ("a",)], "label string"), 50.0, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["filtered_labels"] == ["a", "b"]
    (tmp_path / "t.txt").write_text("\n Hello\n{keywords}\n")
    assert readers.read_template(spark, str(tmp_path / "t.txt")) == "Hello\n{keywords}"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("A001 b2",), ("a002",)], "codes string").write.parquet(src)
    stream = events.stream_table(spark, src, "codes string")
    query = events.running_label_counts(stream, "codes").writeStream.outputMode("complete").format("memory").queryName("labels_so_far").start()
    query.processAllAvailable()
    query.stop()
    assert {r["label"]: r["n"] for r in spark.table("labels_so_far").collect()} == {"a00": 2, "b2": 1}


def test_windowed_counts_and_normalised_streams(spark, tmp_path):
    from datetime import datetime

    src, at = str(tmp_path / "in"), lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(at(1, 5), "a", "Été"), (at(1, 50), "a", "X-y"), (at(2, 0), "b", None), (at(5, 0), "a", "")]
    spark.createDataFrame(rows, "at timestamp, kind string, text string").coalesce(1).write.parquet(src)
    stream = events.stream_table(spark, src, "at timestamp, kind string, text string")
    query = events.windowed_counts(stream, "at", "kind").writeStream.outputMode("append").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    # The last window is still open: the watermark is ten minutes before five.
    assert sorted((r["start"].hour, r["kind"], r["n"]) for r in spark.table("counted").collect()) == [(1, "a", 2), (2, "b", 1)]
    query = events.normalized_stream(stream, "text").writeStream.format("memory").queryName("plain").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["normalized"] or "" for r in spark.table("plain").collect()) == ["", "", "ete", "x y"]


def test_counts_of_a_run(spark, seed, tmp_path):
    paths = runs.supervised_run(spark, seed, str(tmp_path / "run"), n_candidates=2, top_n=5)
    counts = {r["stage"]: r["n"] for r in spark.read.parquet(paths["counts"]).collect()}
    assert counts["generated"] == counts["scored"] == 12 and counts["sft"] == 5 and counts["kto"] == 10


def test_preprocessing_run(spark, tmp_path):
    folder = str(tmp_path / "reports")
    texts = [(f"The patient has hypertension and diabetes, number {i}.", "asthma, gout") for i in range(12)]
    df = spark.createDataFrame(texts, "text string, definitions string")
    for name in ("one", "two"):
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    terms = spark.createDataFrame([("hypertension",), ("diabetes",)], "t string")
    out = runs.preprocessing_run(spark, folder, str(tmp_path / "out"), "Use: {keywords}.", terms, "t").collect()
    assert len(out) == 24 and {r["keywords"] for r in out} == {"hypertension, diabetes"} and out[0]["instruction"] == "Use: hypertension, diabetes."
    assert "text" not in out[0].asDict() and out[0]["response"].startswith("The patient") and len({r["file"] for r in out}) == 2
    mixed = runs.preprocessing_run(spark, folder, str(tmp_path / "mixed"), "{keywords}", terms, "t", random_extraction=True).collect()
    assert {r["keywords"] for r in mixed} == {"hypertension, diabetes", "asthma, gout"}
    given = str(tmp_path / "given")
    spark.createDataFrame([("r", "k1, k2")], "response string, keywords string").write.parquet(given)
    assert runs.preprocessing_run(spark, given, str(tmp_path / "kept"), "{keywords}", terms, "t").first()["instruction"] == "k1, k2"


def test_evaluation_of_several_sets(spark):
    from pyspark.sql import functions as F

    train = spark.createDataFrame([(i, "t", "A1 B2" if i % 2 else "A1 C3") for i in range(10)], "k long, text string, codes string")
    sets = {name: spark.createDataFrame([(1, "a1 only", "A1"), (2, "b2 and a1", "B2 A1"), (3, "none", "Z9")], "k long, text string, codes string") for name in ("main", "other")}
    out = runs.evaluate(train, sets, "k", "text", "codes", lambda text, label: F.when(F.col(text).contains(F.col(label)), 5.0).otherwise(-5.0)).collect()
    assert {r["dataset"] for r in out} == {"main", "other"} and all(r["micro_f1"] == 1.0 and r["hamming_loss"] == 0.0 for r in out)


def test_more_sources_and_writers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x;y\n" + "".join(f"{i};v{i}\n" for i in range(50)), encoding="utf-8")
    sample = [tuple(r) for r in readers.sample_lines(spark, str(path), 7, ["x", "y"], ";").collect()]
    assert len(set(sample)) == 7 and sorted(sample) == sorted(tuple(r) for r in readers.sample_lines(spark, str(path), 7, ["x", "y"], ";").collect())
    assert readers.sample_lines(spark, str(path), 500, ["y"], ";").count() == 50
    assert readers.read_csv(spark, str(path), ["y"], ";", line_breaks=False).count() == 50

    several = f"{tmp_path}/several"
    spark.range(40).repartition(4).write.parquet(several)
    rows = readers.read_table(spark, several, "row").collect()
    assert sorted(r["row"] for r in rows) == list(range(40))

    writers.write_csv_chunks(spark.range(25).selectExpr("id", "id AS v"), "id", f"{tmp_path}/chunks", 10)

    names = sorted(n for n in os.listdir(f"{tmp_path}/chunks") if n.endswith(".csv") and not n.startswith("."))
    assert names == ["chunk_00000.csv", "chunk_00001.csv", "chunk_00002.csv"]
    assert open(f"{tmp_path}/chunks/chunk_00002.csv", encoding="utf-8").read().split() == ["id,v", *[f"{i},{i}" for i in range(20, 25)]]

    copied = writers.copy_seeds(spark, several, several, str(tmp_path / "run"), "org/model", 100)
    assert copied["private"].endswith("model_org-model_size_100/private_seed") and spark.read.parquet(copied["public"]).count() == 40
    assert writers.write_counted(spark.range(33), f"{tmp_path}/counted") == 33

    words = tmp_path / "stop.txt"
    words.write_text("The\n\nun\nthe\n", encoding="utf-8")
    assert readers.read_stopwords(spark, str(words)) == ("the", "un")
    definitions = tmp_path / "d.jsonl"
    definitions.write_text('{"term": "gout", "definition": "x"}\n{"term": " "}\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_definitions(spark, str(definitions)).collect()] == [("gout", "x")]
    assert writers.with_chunk(spark.range(3), "id", 2).count() == 3
