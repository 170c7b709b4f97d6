"""Queries over the synthetic tables, one or more for each operator, and the inputs derived for them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import prompts, scores, text
from textloom.operators import candidates as cand
from textloom.operators import chunks, codes, keywords, labels, metrics, ordering, plugins, preferences, sentences, vocabulary
from textloom.operators.bleu import sentence_bleu
from textloom.sources.writers import with_chunk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

INSTRUCTION = "### Instruction\nWrite a text with these keywords.\n### Keywords\n{keywords}{knowledge_base}\n### Output\n"
PAIR = "A: {TEXT1}\nB: {TEXT2}"
JUDGE = "Rate this.\n{INSTRUCTION}\n"
TOP, TRAINED, TRUNCATED = preferences.TOP_N, 900, 512


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c: Column) -> Column:
    """Rounded, so that the order of summing up doesn't show."""
    return F.round(c, 6)


# Inputs -----------------------------------------------------------------------------------------


def candidates_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as four candidates each for an example, with scores from their ids."""
    d = F.col("doc_id")
    scored = table(spark, sf_dir, "documents").select(
        ((d - d % 4) / 4).cast("bigint").alias("example_id"), (d % 4 + 1).cast("int").alias("candidate_id"), F.col("source").alias("instruction"), F.col("text").alias("response"), "doc_id",
        (((d * 7919) % 1000) / 1e3).alias("similarity_score"), (((d * 104729) % 997) / 997.0).alias("educational_score"), (((d * 15485863) % 991) / 991.0).alias("bleu_score"), (((d * 31) % 5) / 4.0).alias("overlap_keys"),
    )
    return scored.withColumn("cumulative_score", scores.mean_of(F.col("overlap_keys"), F.col("educational_score"), F.col("similarity_score")))


def candidates_wide(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    long = candidates_long(spark, sf_dir)
    names = ["similarity_score", "educational_score", "bleu_score", "overlap_keys"] + ["response"]
    values = {**{n: F.col(n) for n in names}, "response": F.col("response") if with_text else F.md5("response")}
    columns = [F.max(F.when(F.col("candidate_id") == i, values[n])).alias(f"{n}_{i}") for i in range(1, 5) for n in names]
    return long.groupBy("example_id").agg(F.min_by("instruction", "candidate_id").alias("instruction"), *columns)


def coded_orders(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    """(order_id, codes): the codes of an order's parts joined by spaces, in a total order of its lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col(code).alias("_code")), F.col("l_partkey") == F.col("p_partkey"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "_code")
    grouped = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select("order_id", F.array_join(F.transform("rows", lambda r: r["_code"]), " ").alias("codes"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, term, at): the distinct pairs of brand and part name, by first occurrence."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code"), F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("at"))


LABELS = ["eco", "lar", "med", "pro", "sma", "sta"]


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, sample, label, y, logit) over the coded orders."""
    own = coded_orders(spark, sf_dir, "p_type").withColumn("labels", labels.label_array("codes"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(i).alias("i")) for i, x in enumerate(LABELS)]))
    rows = own.select(F.col("order_id").alias("sample"), "labels", each.alias("l"))
    logit = ((F.col("sample") * 31 + F.col("l.i") * 17) % 201 - 100) / 25e0 + F.col("l.i") / 1e3
    return rows.select(F.when(F.col("sample") % 3 == 0, "second").otherwise("first").alias("dataset"), "sample", F.col("l.label").alias("label"), F.array_contains("labels", F.col("l.label")).cast("int").alias("y"), logit.alias("logit"))


# Text -------------------------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text("text").alias("normalized"))


@query
def remove_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_symbols("text").alias("plain"))


@query
def code_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.code_prefix("p_brand").alias("prefix"), text.slug(F.concat(F.lit("a/"), "p_type")).alias("slug"))


@query
def split_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_at_marker("text").alias("head"))


@query
def instruction_build(spark, sf_dir):
    words = F.array_join(F.slice(F.array_distinct(text.letter_words("text")), 1, 5), ", ")
    return table(spark, sf_dir, "documents").select("doc_id", prompts.instruction_prompt(INSTRUCTION, words).alias("instruction"))


@query
def pair_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    left = docs.select("doc_id", F.concat(F.col("text"), F.lit(" {TEXT2}")).alias("a"))
    right = docs.select((F.col("doc_id") - 1).alias("_i"), F.col("text").alias("b"))
    return left.join(right, F.col("doc_id") == F.col("_i")).select("doc_id", prompts.pair_prompt(PAIR, F.col("a"), F.col("b")).alias("prompt"))


@query
def judge_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.judge_prompt(JUDGE, F.col("text")).alias("prompt"))


@query
def sft_text_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    said = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("response"))
    pairs = asked.join(said, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    return pairs.select("conv_id", "turn", prompts.training_text(F.col("instruction"), F.col("response")).alias("text"))


@query
def judge_score_parse(spark, sf_dir):
    n = F.col("doc_id") % 7
    good = F.concat(F.lit('ok {"score": '), F.col("quality").cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"), F.lit(",\n}"))
    answer = F.when(n == 0, '{"score": 2}').when(n == 1, "score: 0.5").when(n == 2, '{"score": 0.5, "why": "x"}').when(n == 3, '{ "score" : 1 }').otherwise(good)
    return table(spark, sf_dir, "labels").select("doc_id", scores.extract_score(answer).alias("score"))


@query
def preferred_output(spark, sf_dir):
    """Judges' answers made from the labels: a, b, a tie, or neither."""
    n = F.col("doc_id") % 4
    answer = F.when(n == 0, "I prefer Output (a).").when(n == 1, "Output (b) is better").when(n == 2, "Tie between them").otherwise("output (c)")
    return table(spark, sf_dir, "labels").select("doc_id", prompts.preferred_output(answer).alias("preferred"))


@query
def newline_to_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.newline_to_space("text").alias("line"))


@query
def heading_order_check(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.in_section_order(html, ("<title>", "<nav>", "<article>")).alias("in_order"), text.in_section_order(html, ("<article>", "<title>")).alias("reversed"))


@query
def given_or_extracted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(text.letter_words("text")), 1, 3), ", ").alias("keywords"), F.col("source").alias("definitions"))
    return keywords.given_or_extracted(docs, "doc_id", "definitions").select("doc_id", "keywords")


# Codes ------------------------------------------------------------------------------------------


@query
def literal_list_parse(spark, sf_dir):
    k = F.col("p_partkey") % 5
    literal = F.when(k == 0, F.concat(F.lit("['"), F.col("p_name"), F.lit("'"))).when(k == 1, "{'a': 1}").when(k == 2, "plain").otherwise(F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_type"), F.lit("']")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.parse_literal_list(literal), "|").alias("items"))


@query
def invert_norm_keywords(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    originals = part.select(F.upper("p_name").alias("original"), text.normalize_text("p_name").alias("normal"), "p_partkey")
    rows = part.select("p_partkey", F.concat(F.lit("['"), text.normalize_text("p_name"), F.lit("', '"), text.normalize_text("p_name"), F.lit("']")).alias("literal"))
    return codes.original_keywords(rows, "p_partkey", "literal", originals, "normal", "original", "p_partkey")


@query
def code_to_terms(spark, sf_dir):
    return codes.code_terms(dictionary(spark, sf_dir), "code", "term", "at").select("code", F.array_join("terms", ", ").alias("terms"))


@query
def code_lookup(spark, sf_dir):
    terms = codes.code_terms(dictionary(spark, sf_dir), "code", "term", "at")
    found = codes.lookup_terms(coded_orders(spark, sf_dir, "p_brand"), "codes", terms)
    return found.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_codes"), F.sum(F.size("terms")).cast("bigint").alias("n_terms"))


@query
def code_int_map(spark, sf_dir):
    numbers = codes.code_numbers(dictionary(spark, sf_dir), "code")
    return codes.encode_codes(coded_orders(spark, sf_dir, "p_brand"), "order_id", "codes", numbers)


@query
def random_codes(spark, sf_dir):
    terms = codes.code_terms(dictionary(spark, sf_dir), "code", "term", "at")
    return codes.random_code_sets(spark.range(0, 200).withColumnRenamed("id", "sample"), "sample", terms, 3, 2, 42)


@query
def assoc_codes(spark, sf_dir):
    terms = codes.code_terms(dictionary(spark, sf_dir), "code", "term", "at")
    own = coded_orders(spark, sf_dir, "p_brand").select("order_id", F.substring_index("codes", " ", 1).alias("diagnostic"), F.regexp_extract("codes", r"^\S+\s*(.*)$", 1).alias("others"))
    return codes.associated_code_sets(own, "order_id", "diagnostic", "others", terms, 3, 2, 42)


@query
def reverse_dictionary(spark, sf_dir):
    """The originals of each normal form; names are there as they are, in capitals and with a dash."""
    part = table(spark, sf_dir, "part")
    forms = F.explode(F.array("p_name", F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("term")
    found = codes.originals_of(part.select("p_partkey", forms).groupBy("term").agg(F.min("p_partkey").alias("at")), "term", "at")
    return found.select("normal", F.array_join("originals", "|").alias("originals"))


@query
def random_codes_by_number(spark, sf_dir):
    """Codes drawn by number from a dictionary that is too large to rank whole: all orders' keys."""
    terms = table(spark, sf_dir, "orders").select(F.format_string("o%d", "o_orderkey").alias("code"), F.array("o_orderpriority", "o_orderstatus").alias("terms"))
    return codes.random_code_sets(spark.range(0, 1000).withColumnRenamed("id", "sample"), "sample", terms, 3, 2, 42)


# Candidates -------------------------------------------------------------------------------------


@query
def positional_zip(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(((d - d % 2) / 2).cast("bigint").alias("row"), d, (d % 2).alias("odd"))
    zipped = cand.zip_positional(docs.filter("odd = 0").drop("odd"), docs.filter("odd = 1").drop("odd"), "row")
    return zipped.select("row", "doc_id", "public_doc_id")


@query
def unpivot_candidates(spark, sf_dir):
    wide = cand.add_cumulative(candidates_wide(spark, sf_dir))
    long = cand.unpivot_candidates(wide)
    return long.filter("response is not null").select("example_id", "candidate_id", "instruction", "response", six(F.col("similarity_score")).alias("similarity_score"), six(F.col("educational_score")).alias("educational_score"), six(F.col("bleu_score")).alias("bleu_score"), six(F.col("cumulative_score")).alias("cumulative_score"))


@query
def cumulative_score(spark, sf_dir):
    wide = cand.add_cumulative(candidates_wide(spark, sf_dir))
    return wide.select("example_id", *[six(F.col(f"cumulative_score_{i}")).alias(f"cumulative_score_{i}") for i in range(1, 5)])


@query
def score_stats(spark, sf_dir):
    stats = cand.score_statistics(cand.add_cumulative(candidates_wide(spark, sf_dir)))
    return stats.select("metric", *[six(F.col(c)).alias(c) for c in ("mean", "max", "min", "median")])


@query
def sorted_candidates(spark, sf_dir):
    ranked = ordering.with_ordinal(candidates_long(spark, sf_dir).select("example_id", "candidate_id", "cumulative_score"), *cand.score_order("avg"), name="rank")
    return ranked.select("rank", "example_id", "candidate_id", six(F.col("cumulative_score")).alias("cumulative_score"))


@query
def sft_top(spark, sf_dir):
    return preferences.supervised_set(candidates_long(spark, sf_dir), TOP).select("example_id", "candidate_id", "instruction", F.md5("response").alias("response"))


@query
def eval_top(spark, sf_dir):
    return cand.best(candidates_long(spark, sf_dir), TOP, "s").select("example_id", "candidate_id", six(F.col("similarity_score")).alias("similarity_score"))


@query
def kto_pairs(spark, sf_dir):
    rows = preferences.binary_set(candidates_long(spark, sf_dir), TOP)
    return rows.select("instruction", "label", F.md5("response").alias("response"), F.md5("completion").alias("completion"), "prompt")


@query
def dpo_pairs(spark, sf_dir):
    pairs = preferences.preference_pairs(candidates_long(spark, sf_dir), TOP)
    return pairs.select("rank", "instruction", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), *[six(F.col(f"{side}_{s}")).alias(f"{side}_{s}") for side in ("chosen", "rejected") for s in preferences.SCORES])


@query
def dpo_trainer_input(spark, sf_dir):
    rows = preferences.trainer_input(preferences.preference_pairs(candidates_long(spark, sf_dir), TOP), n=TRAINED)
    return rows.select("rank", "prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "split")


@query
def best_by_sort(spark, sf_dir):
    """The 50 best candidates in each of the named orders."""
    long = candidates_long(spark, sf_dir).withColumn("educational_score", F.floor(F.col("educational_score") * 8) / 8).withColumn("similarity_score", F.floor(F.col("similarity_score") * 8) / 8)
    tops = [cand.best(long, 50, sort).select(F.lit(sort).alias("sort"), "example_id", "candidate_id") for sort in cand.SORTS]
    return reduce(DataFrame.union, tops)


@query
def below_score(spark, sf_dir):
    scored = candidates_long(spark, sf_dir).withColumn("educational_score", F.col("educational_score") * 10)
    return cand.below_score(scored, 6.0).select("example_id", "candidate_id", six(F.col("educational_score")).alias("educational_score"))


@query
def stage_counts(spark, sf_dir):
    """The rows at each step from documents to preference pairs, in one row for each step."""
    long = candidates_long(spark, sf_dir)
    steps = {"documents": table(spark, sf_dir, "documents"), "candidates": long, "sft": preferences.supervised_set(long, TOP), "kto": preferences.binary_set(long, TOP), "dpo": preferences.preference_pairs(long, TOP)}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in steps.items()]
    return reduce(DataFrame.union, counted)


@query
def semi_any_medical(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), (F.col("toxic") == 1).alias("medical"))
    long = candidates_long(spark, sf_dir).join(flags, F.col("doc_id") == F.col("_d"), "left").withColumn("medical", F.coalesce("medical", F.lit(False)))
    return cand.with_any(long, "medical").select("example_id", "candidate_id", "medical")


# Scores -----------------------------------------------------------------------------------------


@query
def keyword_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("keys", F.array_join(F.slice(F.array_distinct(text.letter_words("text")), 2, 6), ", "))
    return cand.add_keyword_overlap(docs, "keys", "text").select("doc_id", six(F.col("overlap_keys")).alias("overlap"))


@query
def bleu_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("_d"), F.col("text").alias("other"))
    pairs = docs.join(nxt, F.col("doc_id") == F.col("_d")).select(F.concat(F.lit("n"), "doc_id").alias("pair"), "text", "other")
    own = docs.select(F.concat(F.lit("s"), "doc_id").alias("pair"), F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 7 != 6), " ").alias("text"), F.col("text").alias("other"))
    return sentence_bleu(pairs.unionByName(own), "pair", "text", "other").select("pair", six(F.col("bleu_score")).alias("bleu"))


@query
def cosine_similarity(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    nxt = vectors.select((F.col("vec_id") - 1).alias("_v"), F.col("embedding").alias("_e"))
    return vectors.join(nxt, F.col("vec_id") == F.col("_v")).select("vec_id", six(scores.cosine(F.col("embedding"), F.col("_e"))).alias("cosine"))


@query
def window_min_similarity(spark, sf_dir):
    """The vectors of a label are the windows; the first of them is what they are held against."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.groupBy(F.col("label").alias("_l")).agg(F.min_by("embedding", "vec_id").alias("_e"))
    each = vectors.join(first, F.col("label") == F.col("_l")).select("label", "vec_id", scores.cosine(F.col("embedding"), F.col("_e")).alias("c"))
    rows = each.groupBy("label").agg(F.collect_list("c").alias("windows"), F.max_by("c", "vec_id").alias("whole"))
    return rows.select("label", six(scores.windowed_similarity(F.col("whole"), F.col("windows"))).alias("similarity"))


# Labels and metrics -----------------------------------------------------------------------------


@query
def label_counts(spark, sf_dir):
    return labels.label_counts(coded_orders(spark, sf_dir, "p_type"), "order_id", "codes")


@query
def distinct_labels(spark, sf_dir):
    return labels.distinct_labels(coded_orders(spark, sf_dir, "p_type"), "codes")


@query
def label_topk(spark, sf_dir):
    return labels.top_labels(labels.label_counts(coded_orders(spark, sf_dir, "p_type"), "order_id", "codes"), 4).select("label", "n")


@query
def label_top_pct(spark, sf_dir):
    return labels.top_labels(labels.label_counts(coded_orders(spark, sf_dir, "p_type"), "order_id", "codes"), 50, 50.0).select("label", "n")


@query
def multilabel_samples(spark, sf_dir):
    return labels.keep_labels(coded_orders(spark, sf_dir, "p_type"), "codes", ["eco", "med", "pro"], 3).select("order_id", F.array_join("labels", " ").alias("labels"))


@query
def multi_hot(spark, sf_dir):
    own = coded_orders(spark, sf_dir, "p_type").withColumn("labels", labels.label_array("codes"))
    return own.select("order_id", F.array_join(F.transform(labels.multi_hot("labels", LABELS), lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query
def pos_weights(spark, sf_dir):
    own = coded_orders(spark, sf_dir, "p_type").withColumn("labels", labels.label_array("codes"))
    return labels.positive_weights(own, "labels", LABELS).select("label", "pos", six(F.col("weight")).alias("weight"))


def _metric(spark, sf_dir, f):
    df = f(metrics.predictions(logits(spark, sf_dir)))
    return df.select("dataset", *[six(F.col(c)).alias(c) for c in df.columns if c != "dataset"])


@query
def metrics_hamming(spark, sf_dir):
    return _metric(spark, sf_dir, metrics.hamming_loss)


@query
def metrics_jaccard(spark, sf_dir):
    return _metric(spark, sf_dir, metrics.sample_jaccard)


@query
def metrics_macro(spark, sf_dir):
    return _metric(spark, sf_dir, metrics.macro_scores)


@query
def metrics_micro(spark, sf_dir):
    return _metric(spark, sf_dir, metrics.micro_scores)


@query
def metrics_f1_at_k(spark, sf_dir):
    return _metric(spark, sf_dir, metrics.f1_at_k)


@query
def metrics_by_dataset(spark, sf_dir):
    df = metrics.all_metrics(logits(spark, sf_dir))
    return df.select("dataset", *[six(F.col(c)).alias(c) for c in df.columns if c != "dataset"])


# Vocabulary and keywords ------------------------------------------------------------------------


@query
def vocab_counts(spark, sf_dir):
    return vocabulary.word_counts(table(spark, sf_dir, "documents"), "text")


@query
def vocab_percentile_band(spark, sf_dir):
    band = vocabulary.percentile_band(vocabulary.word_counts(table(spark, sf_dir, "documents"), "text"))
    return band.select(six(F.col("low")).alias("low"), six(F.col("high")).alias("high"))


@query
def vocab_filtered(spark, sf_dir):
    return vocabulary.filter_vocabulary(vocabulary.word_counts(table(spark, sf_dir, "documents"), "text"))


@query
def fuzzy_match(spark, sf_dir):
    """Part names and words of the benchmark, each with a letter more and a letter less, against the documents' vocabulary and the part names."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("t"))
    words = lambda name: table(spark, sf_dir, name).select(F.explode(text.letter_words("text")).alias("t"))
    terms, said = words("documents").union(names).distinct(), words("benchmark").union(names).distinct()
    asked = said.select(F.concat("t", F.lit("s")).alias("t")).union(said.select(F.expr("concat(substring(t, 1, 2), substring(t, 4))")))
    found = keywords.fuzzy_match(asked, "t", keywords.term_index(terms, "t"))
    return found.select("text", "term", six(F.col("similarity")).alias("similarity"))


@query
def candidate_spans(spark, sf_dir):
    return keywords.candidate_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def resolve_overlaps(spark, sf_dir):
    """All spans of all documents as matches."""
    spans = keywords.candidate_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    matches = spans.select("doc_id", "start", "end", F.length("span").alias("n_term"), F.col("span").alias("term"))
    return keywords.resolve_overlaps(matches, "doc_id").select("doc_id", "start", "end", "match")


@query
def keyword_extraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = vocabulary.filter_vocabulary(ordering.cut_table(vocabulary.word_counts(docs, "text")))  # read twice
    return keywords.extract_keywords(docs, "doc_id", "text", counts, "word").select("doc_id", "keywords")


@query
def sentence_model(spark, sf_dir):
    model = sentences.train_sentences(table(spark, sf_dir, "documents"), "text")
    return model.withColumn("score", six(F.col("score")))


@query
def ordered_dedup(spark, sf_dir):
    return coded_orders(spark, sf_dir, "p_brand").select("order_id", text.ordered_distinct(F.split("codes", " ")).alias("keywords"))


# Samples and chunks -----------------------------------------------------------------------------


@query
def train_test_split(spark, sf_dir):
    return ordering.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def sample_rows(spark, sf_dir):
    return ordering.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@query
def shuffle_rows(spark, sf_dir):
    return ordering.shuffle_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def head_rows(spark, sf_dir):
    return ordering.head_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 50)


@query
def dataset_size_all(spark, sf_dir):
    return ordering.head_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", -1)


def _chunked(spark, sf_dir, size, stride):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0)), lambda t: (F.length(t) + 1).cast("int")).alias("ids"))
    rows = chunks.token_chunks(docs, "ids", size, stride)
    return rows.select("doc_id", "chunk", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query
def token_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir, 64, 64)


@query
def token_chunks_overlapping(spark, sf_dir):
    return _chunked(spark, sf_dir, 64, 48)


@query
def token_truncate(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", chunks.truncate_tokens(F.col("text"), words, TRUNCATED).alias("text"))


@query
def sliding_windows(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.token_windows(words)).alias("window", "tokens"))
    return rows.select("doc_id", "window", F.array_join("tokens", " ").alias("tokens"))


@query
def csv_chunk_ids(spark, sf_dir):
    return with_chunk(table(spark, sf_dir, "events").select("event_id"), "event_id", 1000)


# Plug-ins ---------------------------------------------------------------------------------------


@query
def generation_stub(spark, sf_dir):
    return plugins.generate_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", plugins.EchoGenerator()).drop("text")


@query
def judge_stub(spark, sf_dir):
    return plugins.add_judge_score(table(spark, sf_dir, "documents"), "text", plugins.HeuristicJudge(), JUDGE).select("doc_id", "educational_score")


@query
def embed_stub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("_i"), F.col("text").alias("other"))
    pairs = docs.join(nxt, F.col("doc_id") == F.col("_i"))
    return plugins.add_similarity(pairs, "text", "other", plugins.HashEmbedder(), plugins.WordTokenizer()).select("doc_id", six(F.col("similarity_score")).alias("similarity"))


@query
def pair_judge_stub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("_i"), F.col("text").alias("other"))
    pairs = docs.join(nxt, F.col("doc_id") == F.col("_i"))
    return plugins.add_pair_score(pairs, "text", "other", plugins.HeuristicJudge(), PAIR).select("doc_id", "similarity_score")
