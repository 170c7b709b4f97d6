import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import prompts, scores, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def decomposed(c):
    """The code points that a character stands for, by the decompositions that the character database lists."""
    listed = [x for x in unicodedata.decomposition(c).split() if not x.startswith("<")]
    return "".join(decomposed(chr(int(x, 16))) for x in listed) if listed else c


def plain_normal(t):
    """One pass over code points: what each contributes to the words."""
    out = []
    for d in "".join(" " if c in "–—−" else decomposed(c) for c in t):
        kind = unicodedata.category(d)[0] if d.isascii() else None
        out.append(d.lower() if kind == "L" else " " if kind in ("P", "S", "Z") else "")
    return " ".join("".join(out).split())


def test_normalize_cases(spark):
    cases = {"cœur–L’index\nÉté 12mg/l": "cur lindexete mg l", "": "", "   --  ": "", "H²O": "ho", "a\nb": "ab", "ﬁn Ĳ": "fin ij", "a…b": "a b", "x™y": "xtmy", "№5 ㎏": "no kg", "𝐀b 𝟗": "ab", "½ ⑽ Ⅷ": "viii", "🄐": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", text.normalize_text("v")).collect()} == cases


def test_every_code_point(spark):
    """Alone and between letters, against the decomposition that Python has and against the pass above."""
    points = [chr(p) for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    size = 64
    rows = [(i, "x" + "x".join(points[i : i + size]) + "x") for i in range(0, len(points), size)] + [(-1 - ord(c), c) for c in points if unicodedata.decomposition(c)]
    got = spark.createDataFrame(rows, "i int, v string").repartition(8).select("i", text.remove_accents("v").alias("a"), text.normalize_text("v").alias("n")).collect()
    texts = dict(rows)
    for r in got:
        assert r["a"] == unicodedata.normalize("NFKD", texts[r["i"]]).encode("ascii", "ignore").decode(), hex(r["i"])
        assert r["n"] == plain_normal(texts[r["i"]]), hex(r["i"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=40), min_size=30, max_size=60))
def test_normalize_is_that_of_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    assert {r["i"]: r["n"] for r in df.select("i", text.normalize_text("v").alias("n")).collect()} == {i: plain_normal(t) for i, t in enumerate(texts)}


def test_text_functions(spark):
    assert one(spark, text.remove_symbols("v"), "é_A.1-ß") == "é_A1ß"
    assert one(spark, text.cut_at_marker("v"), " \n a b \t### c ### d") == "a b"
    assert one(spark, text.cut_at_marker("v"), " a ") == " a "
    assert one(spark, text.cut_at_marker("v"), None) is None
    assert one(spark, text.split_words("v"), "  a  b\tc ") == ["a", "b", "c"] and one(spark, text.split_words("v"), None) == []
    assert [one(spark, text.parse_literal_list("v"), v) for v in ("['a', 'b']", "['a", "{'a':1}", None)] == [["a", "b"], [], [], []]
    assert one(spark, text.ordered_distinct("v"), ["b", "a", "b"], "array<string>") == "b, a"
    assert one(spark, text.base_name("v"), "/x/y.z/file.tar.parquet") == "file.tar"
    assert one(spark, text.in_section_order("v"), "\n".join(text.SECTIONS)) and not one(spark, text.in_section_order("v"), "\n".join(reversed(text.SECTIONS)))
    assert one(spark, text.newline_to_space("v"), "a\nb") == "a b"


def test_prompts(spark):
    assert one(spark, prompts.instruction_prompt("K {keywords}{knowledge_base}.", F.col("v")), "a, b") == "K a, b."
    assert one(spark, prompts.pair_prompt("{TEXT1}|{TEXT2}", F.col("v"), F.lit("z")), "x {TEXT2}") == "x z|z"
    assert [one(spark, prompts.preferred_output(F.col("v")), a) for a in ("Output (b)", "Tie", "?")] == ["b", "tie", None]


def test_scores(spark):
    cases = {'{"score": 0.85,\n}': 0.85, '{"score": 1.9}': 1.9, '{"score": 0.5, "why": "x"}': 0.0, "score: 0.5": 0.0, '{"score": 2}': 0.0, None: 0.0}
    assert {v: one(spark, scores.extract_score(F.col("v")), v) for v in cases} == cases
    assert one(spark, scores.mean_of(F.lit(1.0), F.lit(None), F.lit(0.0), F.lit(float("nan"))), "") == 0.5
    assert one(spark, scores.mean_of(F.lit(None).cast("double")), "") is None
    overlap = lambda keys, t: spark.createDataFrame([(keys, t)], "k string, t string").select(scores.keyword_overlap(F.col("k"), "t")).first()[0]
    assert overlap("", "x") == 1.0 and overlap("a, a, zz", "a b") == 2 / 3 and overlap("edema", "oedema") == 1.0
    assert one(spark, scores.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))), [1.0, 2.0], "array<double>") == 0.0
    assert one(spark, scores.sigmoid(F.col("v")), -1e9, "double") < 1e-40
