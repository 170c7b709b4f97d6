"""The pipeline's stages against plain Python, each on its own input."""

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: r[0])


def test_names_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == COLUMNS


def test_line_dedup_stage(spark, docs):
    before = docs.collect()
    pages = {}
    for r in before:
        pages.setdefault(r["source"], []).append({x.strip() for x in r["text"].split("\n") if x.strip()})
    bad = {s: {x for p in own for x in p if (n := sum(x in q for q in own)) >= min(5, max(2, -(-len(own) // 2))) and n > 0.01 * len(own)} for s, own in pages.items()}
    want = []
    for r in before:
        kept = [x for x in r["text"].split("\n") if not x.strip() or x.strip() not in bad[r["source"]]]
        text = "\n".join(kept)
        dropped = len(kept) < len(r["text"].split("\n")) and text.strip()
        want.append((r["doc_id"], text if dropped else r["text"], r["lang"], r["source"], len(text) if dropped else r["n_chars"]))
    assert rows(corpus_pipeline.line_dedup(spark, docs, SF)) == sorted(want)


def test_decontamination_stage(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))
    clean = []
    for r in docs.collect():
        w = words(r["text"])
        hit = {p for n, known in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in known for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r["doc_id"])
    assert [r[0] for r in rows(corpus_pipeline.decontamination(spark, docs, SF))] == sorted(clean)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] for r in out)
    assert len({r["doc_id"] for r in out}) == len(out)


ODD = [(1, None, "en", "s", None, "m"), (2, "", None, None, 0, "m"), (None, "x y", "en", "s", 3, "m"), (4, "same", "en", "t", 4, "m"), (4, "same", "en", "t", 4, "m"), (5, "long " * 30_000, "en", "s", 150_000, "m")]


@pytest.mark.parametrize("name", ["score", "n_dropped", "before", "others", "copies_", "_digest", "spans", "n_words", "items", "ordinal"])
def test_odd_rows(spark, name):
    df = spark.createDataFrame(ODD, f"doc_id long, text string, lang string, source string, n_chars long, {name} string")
    whole = sorted(map(str, ODD))
    for stage, f in corpus_pipeline.STAGES:
        done = [tuple(r) for r in f(spark, df, SF).select(*df.columns).collect()]
        if stage in ("toxicity", "line_dedup", "decontamination"):
            assert sorted(map(str, done)) == whole, stage
        elif stage == "near_dedup":  # null and empty are one, and so are the repeated rows
            assert sorted(str(r[0]) for r in done) == ["1", "4", "5", "None"]
        else:
            assert set(map(str, done)) <= set(whole)
        assert f(spark, df.limit(0), SF).count() == 0, stage


def test_no_labels_keep_all(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
