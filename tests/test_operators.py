import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import bleu_tokens
from textloom.operators import bleu, candidates, chunks, codes, keywords, labels, metrics, ordering, plugins, preferences, vocabulary

LONG = "example_id long, candidate_id int, instruction string, response string, similarity_score double, educational_score double, bleu_score double, cumulative_score double"


def long_rows(n, per=3, seed=0):
    rnd = random.Random(seed)
    return [(i, k, f"i{i}", f"r{i}.{k}", rnd.random(), rnd.random(), rnd.random(), rnd.choice([rnd.random(), 0.5, None, float("nan")])) for i in range(n) for k in range(1, per + 1)]


def ordered(rows):
    key = lambda r: (r[7] is None or math.isnan(r[7]), -(0 if r[7] is None or math.isnan(r[7]) else r[7]), r[0], r[1])
    return sorted(rows, key=key)


def test_best_and_worst(spark):
    rows = long_rows(20)
    df = spark.createDataFrame(rows, LONG)
    want = [r[:2] for r in ordered(rows)]
    assert [(r["example_id"], r["candidate_id"]) for r in candidates.best(df, 13).collect()] == want[:13]
    assert {(r["example_id"], r["candidate_id"]) for r in candidates.worst(df, 13).collect()} == set(want[-13:])


@pytest.mark.parametrize("top", [1, 7, 100])
def test_pairs(spark, top):
    rows = long_rows(15, seed=top)
    every = ordered(rows)
    seen = list(dict.fromkeys(r[0] for r in every[:top]))
    want = [(next(r[3] for r in every if r[0] == e), [r[3] for r in every if r[0] == e][-1]) for e in seen]
    got = preferences.preference_pairs(spark.createDataFrame(rows, LONG), top).orderBy("rank").collect()
    assert [(r["chosen"], r["rejected"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_single_candidate_pair(spark):
    row = preferences.preference_pairs(spark.createDataFrame(long_rows(1, 1), LONG)).first()
    assert row["chosen"] == row["rejected"]


def test_binary_set_overlaps_unless_disjoint(spark):
    df = spark.createDataFrame(long_rows(3, 2), LONG)
    assert preferences.binary_set(df, 4).count() == 8 and preferences.binary_set(df, 4, disjoint=True).count() == 6
    assert preferences.binary_set(df, 4).columns == ["instruction", "response", "label", "completion", "prompt"]


def test_unpivot_and_statistics(spark):
    wide = spark.createDataFrame([(0, "a", "x", "y", 0.5, 1.0, 1.0, 0.0, 0.2, 0.2, 1.0, 0.0), (1, "b", "z", None, 0.1, float("nan"), 0.3, 0.4, 0.2, 0.2, 0.0, 0.0)], "example_id long, instruction string, response_1 string, response_2 string, similarity_score_1 double, similarity_score_2 double, educational_score_1 double, educational_score_2 double, bleu_score_1 double, bleu_score_2 double, overlap_keys_1 double, overlap_keys_2 double")
    scored = candidates.add_cumulative(wide)
    assert scored.filter("example_id = 1").first()["cumulative_score_2"] == pytest.approx(0.2)
    assert candidates.unpivot_candidates(scored).count() == 4
    stats = {r["metric"]: r for r in candidates.score_statistics(scored).collect()}
    assert stats["similarity_score"]["max"] == 1.0 and stats["similarity_score"]["median"] == 0.5


def test_with_any(spark):
    df = spark.createDataFrame([(0, True), (0, False), (1, False)], "example_id long, f boolean")
    assert candidates.with_any(df, "f").count() == 2


def plain_bleu(h, r):
    if not h:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
        m = sum(min(c, b[g]) for g, c in a.items())
        if n == 1 and not m:
            return 0.0
        total += math.log((m or 0.1) / max(1, len(h) - n + 1)) / 4
    return (1 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(total)


def test_bleu(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcde.") for _ in range(rnd.randint(0, 12))), " ".join(rnd.choice("abcde.") for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(99, None, "a"), (98, "a b c d", "a b c d"), (97, "a", "a")]
    df = spark.createDataFrame(rows, "k long, h string, r string")
    tokens = {r["k"]: (r["h"], r["r"]) for r in df.select("k", bleu_tokens("h").alias("h"), bleu_tokens("r").alias("r")).collect()}
    for r in bleu.sentence_bleu(df, "k", "h", "r").collect():
        assert r["bleu_score"] == pytest.approx(plain_bleu(*tokens[r["k"]]), abs=1e-12)


def test_labels(spark):
    df = spark.createDataFrame([(1, "A001 a002 B1"), (2, None), (3, "x1 q x2 y"), (4, "")], "k long, codes string")
    counts = {r["label"]: (r["n"], r["first_key"], r["first_pos"]) for r in labels.label_counts(df, "k", "codes").collect()}
    assert counts["a00"] == (2, 1, 0) and counts["b1"] == (1, 1, 2)
    top = [r["label"] for r in labels.top_labels(labels.label_counts(df, "k", "codes"), 2).collect()]
    assert top == ["a00", "b1"]
    assert labels.top_labels(labels.label_counts(df, "k", "codes"), 50, 50.0).count() == 3
    kept = labels.keep_labels(spark.createDataFrame([(1, "x q x y", None), (2, "q", "t")], "k long, codes string, text string"), "codes", ["x", "y"], 2, "text").collect()
    assert [(r["k"], r["labels"], r["text"]) for r in kept] == [(1, ["x", "x"], "")]


def test_positive_weights(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["a"],), (["a"],)], "labels array<string>")
    assert {r["label"]: r["weight"] for r in labels.positive_weights(df, "labels", ["a", "b", "c"]).collect()} == {"a": 0.0, "b": 3.0, "c": 4.0}


def test_metrics(spark):
    rnd = random.Random(3)
    rows = [("d", s, x, int(rnd.random() < 0.4), rnd.uniform(-3, 3)) for s in range(30) for x in "abcd"] + [("d", s, "none", 0, -5.0) for s in range(30)]
    got = metrics.all_metrics(spark.createDataFrame(rows, "dataset string, sample long, label string, y int, logit double")).first()
    p = [(s, x, y, int(z > 0)) for _, s, x, y, z in rows]
    f1 = lambda t: 2 * t[0] / (2 * t[0] + t[1] + t[2]) if sum(t) else 0.0
    count = lambda part: (sum(y & q for *_, y, q in part), sum((1 - y) & q for *_, y, q in part), sum(y & (1 - q) for *_, y, q in part))
    assert got["hamming_loss"] == pytest.approx(sum(y != q for *_, y, q in p) / len(p))
    assert got["macro_f1"] == pytest.approx(sum(f1(count([r for r in p if r[1] == x])) for x in ("a", "b", "c", "d", "none")) / 5)
    assert got["micro_f1"] == pytest.approx(f1(count(p)))
    per = [sorted((r for r in rows if r[1] == s), key=lambda r: (-1 / (1 + math.exp(-r[4])), r[2])) for s in range(30)]
    assert got["f1_at_3"] == pytest.approx(sum(2 * sum(r[3] for r in own[:3]) / (3 + sum(r[3] for r in own)) for own in per) / 30)
    assert metrics.f1_at_k(metrics.predictions(spark.createDataFrame(rows[:2], "dataset string, sample long, label string, y int, logit double")), (3,)).first()["f1_at_3"] is None


def test_chunks(spark):
    def run(ids, size, stride):
        df = spark.createDataFrame([(ids,)], "ids array<int>")
        return [(r["input_ids"], r["attention_mask"], r["labels"]) for r in chunks.token_chunks(df, "ids", size, stride).orderBy("chunk").collect()]

    assert run([], 4, 4) == []
    assert run([1, 2, 3, 4, 5], 4, 4) == [([1, 2, 3, 4], [1] * 4, [1, 2, 3, 4]), ([5, 0, 0, 0], [1, 1, 0, 0], [5, 0, -100, -100])]
    assert [c[0] for c in run([1, 2, 3, 4], 4, 3)] == [[1, 2, 3, 4], [4, 0, 0, 0]]
    starts = lambda n: spark.range(1).select(chunks.window_starts(F.lit(n), 128, 64)).first()[0]
    assert starts(200) == [0, 64] and starts(50) == [0]


def test_ordering(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(101)], "k long, g int")
    for parts in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["k"]: r["ordinal"] for r in ordering.with_ordinal(df, F.col("g"), F.col("k")).collect()}
        assert got == {k: i + 1 for i, (_, k) in enumerate(sorted((k % 3, k) for k in range(101)))}
        split = ordering.train_test_split(df, "k")
        assert split.filter("split = 'test'").count() == 11
        assert ordering.sample_rows(df, "k", 7, 1).count() == 7 and ordering.sample_rows(df, "k", 500).count() == 101
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert ordering.train_test_split(df.limit(0), "k").count() == 0
    assert ordering.with_ordinal(df.limit(0), F.col("k")).count() == 0


def plain_grams(t):
    t = t.ljust(3, "\1")
    seen = Counter()
    out = set()
    for i in range(len(t) - 2):
        seen[t[i : i + 3]] += 1
        out.add((t[i : i + 3], seen[t[i : i + 3]]))
    return out


@pytest.mark.parametrize("measure", ["jaccard", "dice", "cosine", "overlap"])
def test_fuzzy_match(spark, measure):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(3, 9))) for _ in range(60)]
    texts, terms = sorted(set(words[:30] + ["ab", "aaaa"])), sorted(set(words[30:] + ["aaaaa", "aba"]))
    score = {"jaccard": lambda a, b, c: c / (a + b - c), "dice": lambda a, b, c: 2 * c / (a + b), "cosine": lambda a, b, c: c / math.sqrt(a * b), "overlap": lambda a, b, c: c / min(a, b)}[measure]
    want = {(t, u) for t in texts for u in terms if score(len(plain_grams(t)), len(plain_grams(u)), len(plain_grams(t) & plain_grams(u))) >= 0.7 - 1e-12}
    index = keywords.term_index(spark.createDataFrame([(u,) for u in terms], "u string"), "u")
    found = keywords.fuzzy_match(spark.createDataFrame([(t,) for t in texts], "t string"), "t", index, 0.7, measure)
    assert {(r["text"], r["term"]) for r in found.collect()} == want


def test_overlaps(spark):
    rows = [("d", 0, 3, "x", 5), ("d", 2, 4, "y", 5), ("d", 3, 4, "z", 5), ("d", 3, 4, "a", 6)]
    got = keywords.resolve_overlaps(spark.createDataFrame(rows, "k string, start int, end int, term string, n_term int"), "k").orderBy("start").collect()
    assert [(r["start"], r["end"], r["match"]) for r in got] == [(0, 3, "x"), (3, 4, "z")]


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Le patient a une hypertension artérielle. Diabete de type, hypertension arterielle"), (2, None), (3, "rien")], "k long, text string")
    terms = spark.createDataFrame([("Hypertension artérielle",), ("diabète",), ("ab",)], "t string")
    got = {r["k"]: r["keywords"] for r in keywords.extract_keywords(docs, "k", "text", terms, "t").collect()}
    assert got == {1: "hypertension arterielle, diabete", 2: "", 3: ""}


def test_codes(spark):
    terms = spark.createDataFrame([("a", ["t1", "t2", "t3"]), ("b", ["t4"]), ("c", [])], "code string, terms array<string>")
    rows = codes.random_code_sets(spark.range(30).withColumnRenamed("id", "s"), "s", terms, 2, 2, 1).collect()
    assert rows and all(1 <= r["n_codes"] <= 2 and r["n_kws"] > 0 for r in rows)
    linked = spark.createDataFrame([(1, "a", "b zz b"), (2, "b", ""), (3, "zz", "")], "s long, p string, o string")
    got = {r["sample"]: r for r in codes.associated_code_sets(linked, "s", "p", "o", terms, 3, 2, 1).collect()}
    assert got[2]["n_codes"] == 0 and got[2]["codes"] == "b" and 3 not in got and got[1]["codes"].startswith("a")
    numbers = codes.code_numbers(terms, "code")
    assert {r["code"]: r["number"] for r in numbers.collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(Exception, match="unknown code"):
        codes.encode_codes(linked, "s", "p", numbers).collect()


def test_vocabulary(spark):
    docs = spark.createDataFrame([("The cat, the dog",), ("cat cats",), (None,)], "text string")
    counts = {r["word"]: r["n"] for r in vocabulary.word_counts(docs, "text").collect()}
    assert counts == {"the": 2, "cat": 2, "dog": 1, "cats": 1}
    assert {r["word"] for r in vocabulary.filter_vocabulary(vocabulary.word_counts(docs, "text"), 0, 100).collect()} == {"cat", "dog", "cats"}


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, None, "x")], "k long, a string, b string")
    got = {r["k"]: r["similarity_score"] for r in plugins.add_similarity(df, "a", "b", plugins.HashEmbedder(), plugins.WordTokenizer()).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0
    wide = plugins.generate_candidates(df, "b", plugins.EchoGenerator(), 2)
    assert wide.first()["temperature_1"] == 0.2 and 0.6 <= wide.first()["temperature_2"] <= 0.9


def greedy(rows):
    """The matches (start, end, n_term, term) that are kept, by the order that the docstring gives."""
    kept = []
    for s, e, n, t in sorted(rows, key=lambda r: (r[0] - r[1], r[0], r[2], r[3])):
        if all(a >= e or s >= b for a, b, *_ in kept):
            kept.append((s, e, n, t))
    return {(s, e, t) for s, e, _, t in kept}


def test_overlaps_by_brute_force(spark):
    rnd = random.Random(3)
    rows = {(k, s := rnd.randrange(60), s + rnd.randint(1, 5), rnd.randint(1, 4), rnd.choice("abc")) for k in "xyz" for _ in range(50)}
    out = keywords.resolve_overlaps(spark.createDataFrame([(k, s, e, t, n) for k, s, e, n, t in rows], "k string, start int, end int, term string, n_term int"), "k").collect()
    for k in "xyz":
        assert {(r["start"], r["end"], r["match"]) for r in out if r["k"] == k} == greedy([r[1:] for r in rows if r[0] == k])


def test_queries_over_whole_documents(spark, tmp_path):
    import __spark_entry__
    rnd = random.Random(8)
    words = ["kettle", "kettles", "garden", "gardens", "lantern", "river", "rivers", "window"]
    texts = [" ".join(rnd.choice(words) for _ in range(12)) + ". " + " ".join(rnd.choice(words) for _ in range(6)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    every = __spark_entry__.queries()
    for name in ("judge_prompt", "generation_stub", "judge_stub", "keyword_extraction", "resolve_overlaps", "candidate_spans"):
        assert {r["doc_id"] for r in every[name](spark, str(tmp_path)).select("doc_id").collect()} == set(range(20)), name
    for name in ("pair_prompt", "embed_stub"):
        assert {r["doc_id"] for r in every[name](spark, str(tmp_path)).select("doc_id").collect()} == set(range(19)), name

    spans = [(r["doc_id"], r["start"], r["end"], len(r["span"]), r["span"]) for r in keywords.candidate_spans(docs, "doc_id", "text").collect()]
    chosen = every["resolve_overlaps"](spark, str(tmp_path)).collect()
    for i in range(20):
        assert {(r["start"], r["end"], r["match"]) for r in chosen if r["doc_id"] == i} == greedy([x[1:] for x in spans if x[0] == i])

    terms = [r["word"] for r in vocabulary.filter_vocabulary(vocabulary.word_counts(docs, "text")).collect()]
    assert terms
    grams = lambda t: {(t[i : i + 3], sum(t[j : j + 3] == t[i : i + 3] for j in range(i + 1))) for i in range(len(t) - 2)}
    found = {}
    for r in keywords.candidate_spans(docs, "doc_id", "text").collect():
        for t in terms:
            a, b = grams(r["span"]), grams(t)
            if len(a & b) / len(a | b) >= 0.8:
                found.setdefault(r["doc_id"], []).append((r["start"], r["end"], len(b), t))
    want = {i: ", ".join(dict.fromkeys(t for _, _, t in sorted(greedy(found.get(i, []))))) for i in range(20)}
    assert {r["doc_id"]: r["keywords"] for r in every["keyword_extraction"](spark, str(tmp_path)).collect()} == want


def test_bleu_of_odd_rows(spark):
    rows = [(1, None, "a b"), (2, "a b", None), (3, "", ""), (4, "a " * 50_000, "a " * 40_000), (5, "x y z", "x y z"), (5, "x y z", "q")]
    got = bleu.sentence_bleu(spark.createDataFrame(rows, "k long, h string, r string"), "k", "h", "r").collect()
    want = [plain_bleu(*[(t or "").split() for t in r[1:]]) for r in rows]
    assert sorted((r["k"], r["bleu_score"]) for r in got) == [(k, pytest.approx(w)) for k, w in sorted((r[0], w) for r, w in zip(rows, want, strict=True))]


def test_grams_number_repeats(spark):
    texts = ["aaaaaa", "abcabcabc", "a", "", "xyz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keywords.char_grams(F.col("t")).alias("g")).collect()
    for r in rows:
        t = r["t"].ljust(3, "\u0001")
        assert len(r["g"]) == len(set(r["g"])) == max(1, len(t) - 2)
    both = {r["t"]: set(r["g"]) for r in rows}
    assert len(both["aaaaaa"]) == 4 and not both["xyz"] & both["aaaaaa"]


def test_codes_drawn_by_number(spark):
    terms = spark.createDataFrame([(f"c{i:03}", [f"t{i}", f"u{i}"]) for i in range(500)], "code string, terms array<string>")
    rows = codes.random_code_sets(spark.range(400).withColumnRenamed("id", "s"), "s", terms, 3, 2, 1).collect()
    assert len(rows) == 400 and all(len(set(r["codes"].split())) == r["n_codes"] <= 3 for r in rows)
    assert len({c for r in rows for c in r["codes"].split()}) > 300


def test_median_by_ranks(spark):
    rnd = random.Random(2)
    for n in (1, 2, 7, 100):
        values = [rnd.choice([0.25, rnd.random()]) for _ in range(n)]
        wide = spark.createDataFrame([(i, "r", v, v / 2) for i, v in enumerate(values)], "example_id long, response_1 string, similarity_score_1 double, cumulative_score_1 double")
        got = {r["metric"]: r["median"] for r in candidates.score_statistics(wide).collect()}
        ordered_values = sorted(values)
        assert got["similarity_score"] == pytest.approx((ordered_values[(n - 1) // 2] + ordered_values[n // 2]) / 2)


def test_ordinals_with_clashing_names(spark):
    names = ["ordinal", "at", "part", "row", "group", "_at", "_part", "_first", "_everything", "first", "before", "n"]
    df = spark.range(50).select("id", *[F.lit(f"mine {c}").alias(c) for c in names])
    out = ordering.with_ordinal(df, F.col("id").desc()).collect()
    assert sorted((r["ordinal"], r["id"]) for r in out) == [(50 - i, i) for i in range(49, -1, -1)]
    assert all(r[c] == f"mine {c}" for r in out for c in names if c != "ordinal")


def test_tables_are_discarded(spark):
    import os

    table = ordering.cut_table(spark.range(5))
    path = table.cut_path.removeprefix("file:")
    assert os.path.isdir(path) and table.count() == 5
    ordering.discard(table, spark.range(1))
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://x:7077"
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ordering.checkpoint_dir(Session())


def test_given_or_extracted(spark):
    df = spark.range(200).select("id", F.lit("own").alias("keywords"), F.lit("given").alias("definitions"))
    got = [r["keywords"] for r in keywords.given_or_extracted(df, "id", "definitions").collect()]
    assert 60 < got.count("own") < 140 and got.count("own") + got.count("given") == 200


def test_a_tagger_of_ones_own(spark):
    class Upper(plugins.ClosedClassTagger):
        def tags(self, tokens):
            return F.transform(tokens, lambda t: F.struct((t != F.upper(t)).alias("closed"), F.lit(False).alias("stop"), F.lit(False).alias("number"), F.lit(False).alias("mark")))

    docs = spark.createDataFrame([(1, "the BIG cat SAT"), (2, None)], "k long, text string")
    assert {r["span"] for r in keywords.candidate_spans(docs, "k", "text", tagger=Upper()).collect()} == {"BIG", "SAT", "BIG cat SAT"}


def test_scores_below(spark):
    df = spark.createDataFrame([(1, 5.9), (2, 6.0), (3, None), (4, float("nan"))], "k long, educational_score double")
    assert [r["k"] for r in candidates.below_score(df).collect()] == [1]


def test_originals(spark):
    terms = spark.createDataFrame([("Été", 2), ("ete", 1), ("Autre", 3), ("Été", 2)], "t string, at long")
    assert {r["normal"]: r["originals"] for r in codes.originals_of(terms, "t", "at").collect()} == {"ete": ["ete", "Été"], "autre": ["Autre"]}
    notes = spark.createDataFrame([("A001 b2",), (None,), ("a00x",)], "codes string")
    assert {r["label"] for r in labels.distinct_labels(notes, "codes").collect()} == {"a00", "b2"}
