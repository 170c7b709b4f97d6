"""Keyword extraction: candidate spans, fuzzy dictionary match, and overlap resolution."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text, normalize_tokens, ordered_distinct
from textloom.operators import blocks
from textloom.operators.ordering import cut_table, discard, hash_order, shuffle_partitions, shuffles_deleted, small
from textloom.operators.overlaps import resolve_overlaps  # noqa: F401  # callers have it from here
from textloom.operators.plugins import ClosedClassTagger, Tagger

MAX_WINDOW, GRAM, THRESHOLD, MIN_TERM = 5, 3, 0.8, 3
#: Terms' grams are broadcast up to this size.
BROADCAST_BYTES = 32 << 20
#: What texts of spans mean is broadcast up to this size.
MEANT_BYTES = 96 << 20
#: Measures of similarity, from the sizes of two feature sets and of what they share.
MEASURES = {
    "jaccard": lambda a, b, c: c / (a + b - c),
    "dice": lambda a, b, c: 2 * c / (a + b),
    "cosine": lambda a, b, c: c / F.sqrt(a * b),
    "overlap": lambda a, b, c: c / F.least(a, b),
}
#: The least and greatest size of the other set, for a size and a threshold.
SIZES = {
    "jaccard": lambda n, t: (n * t, n / t),
    "dice": lambda n, t: (n * t / (2 - t), n * (2 - t) / t),
    "cosine": lambda n, t: (n * t * t, n / (t * t)),
    "overlap": lambda n, t: (F.lit(0.0), F.lit(1e18)),
}
#: The least share of a set's own features that are the other's too, by threshold.
LEAST_SHARE = {"jaccard": lambda t: t, "dice": lambda t: t / (2 - t), "cosine": lambda t: t * t}


def bound(value: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """``f`` of ``value``, an array that is made only once however often ``f`` uses it; ``kind`` is the type of the result's items."""
    return F.aggregate(F.array(value), F.array().cast(f"array<{kind}>"), lambda _, x: f(x))


def char_grams(text: Column, size: int = GRAM) -> Column:
    """Hashes of character grams; short texts are padded. Repeated grams are told apart by a number.

    In the sorted array a gram's number is its distance from the first one like it.
    """
    padded = F.rpad(text, F.greatest(F.length(text), F.lit(size)), "\u0001")
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (size - 1)), lambda i: F.substring(padded, i, F.lit(size)))
    return bound(F.sort_array(grams), lambda xs: F.transform(xs, lambda g, i: F.xxhash64(g, i - F.array_position(xs, g).cast("int"))), "bigint")


def term_index(terms: DataFrame, term: str, min_length: int = MIN_TERM, size: int = GRAM) -> DataFrame:
    """(term, n_term, grams): the distinct normalised terms with their grams, for ``build_index``. Each distinct term is normalised once."""
    given = terms.select(F.col(term).alias("_given")).distinct()
    normal = given.select(F.explode(F.array(normalize_text("_given"))).alias("term"))  # as a row, else Spark takes both distincts for one and normalises every row
    normal = normal.filter(F.length("term") >= min_length).distinct()
    grams = normal.withColumn("grams", char_grams(F.col("term"), size))
    return grams.select("term", F.size("grams").alias("n_term"), "grams")


@dataclass(frozen=True)
class TermIndex:
    """What texts are matched with: ``counts`` (gram, n), in how many terms each gram is, and
    ``probes`` (gram, size, term, n_term, at, bits), the rarest grams of each term with their places in its
    order from rare to frequent, under each size that a partner may have, which serve ``measure``
    from ``threshold`` on. ``bits`` has one bit set for each of the term's grams, several may share one;
    tables that were stored without it serve too."""

    probes: DataFrame
    counts: DataFrame
    measure: str
    threshold: float


def _first_grams(rows: DataFrame, name: str, n: str, grams: Column, counts: DataFrame, threshold: float, measure: str) -> DataFrame:
    """(name, n, bits, at, gram): of each row's grams the rarest, so many that a partner must have one of them, and the bits of all.

    A partner shares at least as many grams as the least partner has; so it has one of the others and one more.
    """
    each = rows.select(name, n, F.explode(grams).alias("_g")).join(counts, F.col("_g") == F.col("gram"), "left")
    ordered = each.groupBy(name, n).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_g"))).alias("x"), F.bit_or(F.expr("shiftleft(1L, int(_g & 63))")).alias("bits"))
    needed = F.ceil(SIZES[measure](F.col(n), threshold)[0] - 1e-9).cast("int")
    first = F.slice(F.transform("x", lambda x: x["_g"]), F.lit(1), F.least(F.col(n), F.col(n) - needed + 1))
    return ordered.select(name, n, "bits", F.posexplode(first).alias("at", "gram"))


def build_index(index: DataFrame, threshold: float = THRESHOLD, measure: str = "jaccard") -> TermIndex:
    """The index of what ``term_index`` returns, as tables in the shared folder."""
    index = cut_table(index.select("term", "n_term", "grams"))
    counts = cut_table(index.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    probes = _first_grams(index, "term", "n_term", F.col("grams"), counts, threshold, measure)
    least, most = SIZES[measure](F.col("n_term"), threshold)
    sizes = F.array(F.lit(-1)) if measure == "overlap" else F.sequence(F.ceil(least - 1e-9).cast("int"), F.floor(most + 1e-9).cast("int"))  # whose sizes have no bound
    probes = cut_table(probes.select("gram", F.explode(sizes).alias("size"), "term", "n_term", "at", "bits"))
    return TermIndex(probes, counts, measure, threshold)


PROBES, COUNTS = "gram BIGINT, size INT, term STRING, n_term INT, at INT, bits BIGINT", "gram BIGINT, n BIGINT"


def write_term_index(index: DataFrame, path: str, threshold: float = THRESHOLD, measure: str = "jaccard", buckets: int | None = None) -> TermIndex:
    """Stores ``build_index`` at ``path``, its tables bucketed and sorted by gram, and returns it opened.

    Later matches read it bucket by bucket and shuffle only their texts. It serves its measure at
    ``threshold`` and any higher one.
    """
    spark = index.sparkSession
    n = buckets or shuffle_partitions(spark)
    built = build_index(index, threshold, measure)
    for kind, rows, by in (("probes", built.probes, ("gram", "size")), ("counts", built.counts, ("gram",))):
        name = f"textloom_index_{uuid.uuid4().hex}"
        rows.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", f"{path}/{kind}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.createDataFrame([(n, measure, float(threshold))], "buckets int, measure string, threshold double").coalesce(1).write.parquet(f"{path}/about")
    return open_term_index(spark, path)


def open_term_index(spark: SparkSession, path: str) -> TermIndex:
    """The index that ``write_term_index`` stored, with its buckets, in any session."""
    about = spark.read.parquet(f"{path}/about").first()
    place = path.replace("'", "\\'")

    def opened(kind: str, columns: str, by: str) -> DataFrame:
        name = f"textloom_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{place}/{kind}'")
        return spark.table(name)

    return TermIndex(opened("probes", PROBES, "gram, size"), opened("counts", COUNTS, "gram"), about["measure"], about["threshold"])


def _bounds(index: TermIndex) -> tuple[int, int, int]:
    """Least and greatest number of grams of a term, and about how many bytes the probes have in memory."""
    low, high, n, size = index.probes.agg(F.min("n_term"), F.max("n_term"), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return low or 0, high or 0, size + 64 * n


def fuzzy_match(texts: DataFrame, text: str, index: DataFrame | TermIndex, threshold: float = THRESHOLD, measure: str = "jaccard", size: int = GRAM, table: blocks.GramTable | None = None) -> DataFrame:
    """(text, term, n_text, n_term, similarity) of the distinct texts and terms that are alike enough.

    ``index`` is one that was stored or built, or what ``term_index`` returns. Candidates come from
    an equi-join on the rarest grams of each side and the text's size, where the grams from there on
    could still be enough, and all grams by their bits: of grams that aren't shared there are at least as
    many as there are different bits. Rows carry no more than a gram, its place and the bits.
    The grams of the distinct candidates are then compared exactly, from the strings. The index's
    side is broadcast if it was measured to be at most ``BROADCAST_BYTES``, else the texts' if that is.
    With a ``table`` of the index's grams, for normalised texts only, their rarest grams come from array operations.
    """
    if not isinstance(index, TermIndex):
        index = build_index(index, threshold, measure)
    if index.measure != measure or threshold < index.threshold - 1e-12:
        raise ValueError(f"the index serves {index.measure} from {index.threshold} on")
    low, high, n_bytes = _bounds(index)
    asked = texts.select(F.col(text).alias("text")).filter(F.col("text") != "")
    asked = asked.withColumn("n_text", F.greatest(F.length("text") - (size - 1), F.lit(1)))
    n, few = shuffle_partitions(texts.sparkSession), n_bytes <= BROADCAST_BYTES  # a set number, as rows are small and the work on each isn't
    asked = asked.filter(fits(F.col("n_text"), low, high, threshold, measure))
    chosen = F.col("n_text") - SIZES[measure](F.col("n_text"), threshold)[0] + 1
    at_most = 0 if few else asked.agg(F.coalesce(F.sum((F.octet_length("text") + 64) * chosen), F.lit(0.0))).first()[0]  # bytes of the texts' side
    asked = asked.distinct().repartition(n, "text")  # frequent texts are put together before they move
    if table:
        left = asked.mapInArrow(blocks.first_grams(table, blocks.least_size(measure, threshold)), "text string, n_text int, _bits bigint, _at int, _gram bigint")
    else:
        counts = small(index.counts, index.counts.count())
        left = _first_grams(asked, "text", "n_text", char_grams(F.col("text"), size), counts, threshold, measure).withColumnsRenamed({"gram": "_gram", "at": "_at", "bits": "_bits"})
    if not few and at_most <= BROADCAST_BYTES:  # a large index needn't move where the texts are few
        left = F.broadcast(left)
    right = F.broadcast(index.probes) if few else index.probes
    same = (F.col("_gram") == F.col("gram")) & ((F.lit(-1) if measure == "overlap" else F.col("n_text")) == F.col("size"))
    left_over = F.least(F.col("n_text") - F.col("_at"), F.col("n_term") - F.col("at"))
    by_bits = (F.col("n_text") + F.col("n_term") - F.bit_count(F.col("_bits").bitwiseXOR(F.col("bits")))) / 2
    enough = MEASURES[measure](F.col("n_text"), F.col("n_term"), F.least(left_over, by_bits)) >= threshold - 1e-9
    met = left.join(right, same & enough).select("text", "term", "n_text", "n_term")
    met = (met if few else met.repartition(n, "text", "term")).distinct()
    shared = F.size(F.array_intersect(char_grams(F.col("text"), size), char_grams(F.col("term"), size)))
    counted = met.select("*", F.explode(F.array(shared)).alias("_shared"))  # as a row, so that neither the filter nor the formula counts again
    scored = counted.withColumn("similarity", MEASURES[measure](F.col("n_text"), F.col("n_term"), F.col("_shared"))).drop("_shared")
    return scored.filter(F.col("similarity") >= threshold - 1e-12)


def fits(n: Column, low: int, high: int, threshold: float = THRESHOLD, measure: str = "jaccard") -> Column:
    """Whether a text of ``n`` grams may be alike to any term of ``low`` to ``high`` grams; those of unbounded measures may."""
    if measure == "overlap":
        return F.lit(high > 0)
    return (n >= SIZES[measure](F.lit(low), threshold)[0] - 1e-9) & (n <= SIZES[measure](F.lit(high), threshold)[1] + 1e-9)


def _placed_tokens(docs: DataFrame, key: str, text: str, tagger: Tagger) -> DataFrame:
    """(key, t, n, at): the tokens of each sentence, and how many are before it in the text.

    Texts are dealt out by key before they become tokens; nothing that is made of them moves again.
    """
    dealt = docs.select(F.col(key), F.col(text).alias("_text")).repartition(shuffle_partitions(docs.sparkSession), key)
    sentences = dealt.select(F.col(key), F.posexplode(tagger.sentences(F.col("_text"))).alias("pos", "s"))
    tokens = sentences.select(key, "pos", tagger.tokens(F.col("s")).alias("t")).withColumn("n", F.size("t"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("at", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("int")).filter("n > 0")


def _spans(placed: DataFrame, key: str, max_window: int, tokens: str, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, start, end, t): the spans that may be terms, with their items of the column ``tokens``; only those where ``keep`` of place and length in the sentence holds."""
    i, length = F.col("_i"), F.col("_length")
    first, last = F.get("tags", i), F.get("tags", i + length - 1)
    begun = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i")).filter(~first["closed"] & ~first["mark"])
    each = begun.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_window), F.col("n") - i))).alias("_length"))
    valid = each.filter(~last["closed"] & ~((length == 1) & (first["stop"] | first["number"])))
    start = F.col("at") + i
    return (valid.filter(keep(i, length)) if keep else valid).select(key, start.alias("start"), (start + length).alias("end"), F.slice(tokens, i + 1, length).alias("t"))


def candidate_spans(docs: DataFrame, key: str, text: str, max_window: int = MAX_WINDOW, tagger: Tagger | None = None) -> DataFrame:
    """(key, start, end, span): runs of up to ``max_window`` tokens within a sentence that may be terms.

    Tokens come from the tagger and are counted through the text. A span doesn't begin or end with
    a token of a closed class, begin with a mark, or be a single stop word or number. Keys are unique.
    """
    tagger = tagger or ClosedClassTagger()
    placed = _placed_tokens(docs, key, text, tagger).withColumn("tags", tagger.tags(F.col("t")))
    return _spans(placed, key, max_window, "t").select(key, "start", "end", F.array_join("t", " ").alias("span"))


def normal_spans(docs: DataFrame, key: str, text: str, low: int, high: int, max_window: int = MAX_WINDOW, tagger: Tagger | None = None, share: float = 0.0, crossing: tuple[str, ...] = ()) -> DataFrame:
    """(key, start, end, normal): the spans of ``candidate_spans``, normalised, that have ``low`` to ``high`` characters then.

    Each token is normalised once, whatever number of spans it is in. With a ``share`` above 0,
    spans go that can't have so large a share of their grams in common with a term, whose grams
    across words are among ``crossing``. That is told from sums of numbers that each token has once.
    """
    tagger = tagger or ClosedClassTagger()
    tokens = _placed_tokens(docs, key, text, tagger)
    placed = tokens.select(key, "n", "at", tagger.tags(F.col("t")).alias("tags"), normalize_tokens("t").alias("_t"))
    placed = placed.select("*", F.transform("_t", lambda t: F.length(t) + F.when(t == "", 0).otherwise(1)).alias("_long"), _foreign_grams("_t", crossing).alias("_far"))

    def total(name: str, i: Column, length: Column, most: int) -> Column:
        return reduce(lambda a, b: a + b, [F.when(length > q, F.get(name, i + q)).otherwise(0) for q in range(most)], F.lit(0))

    def keep(i: Column, length: Column) -> Column:
        characters = total("_long", i, length, max_window) - 1
        fitting = characters.between(max(low, 1), high)
        if share <= 0:
            return fitting
        return fitting & (total("_far", i, length - 1, max_window - 1) <= (1 - share) * F.greatest(characters - (GRAM - 1), F.lit(1)) + 1e-9)

    spans = _spans(placed, key, max_window, "_t", keep)
    return spans.select(key, "start", "end", F.array_join(F.array_remove("t", ""), " ").alias("normal"))


def _foreign_grams(tokens: str, crossing: tuple[str, ...]) -> Column:
    """For each token, how many grams at the space to the next one, of those with no other space, aren't among ``crossing``; none if one of both is empty."""
    foreign = lambda c: F.when(c.isin(*crossing), 0).otherwise(1) if crossing else F.lit(1)

    def at(a: Column, b: Column) -> Column:
        ends = F.when(F.length(a) > 1, foreign(F.concat(F.right(a, F.lit(2)), F.lit(" ")))).otherwise(0)
        begins = F.when(F.length(b) > 1, foreign(F.concat(F.lit(" "), F.left(b, F.lit(2))))).otherwise(0)
        return F.when((a == "") | (b == ""), 0).otherwise(foreign(F.concat(F.right(a, F.lit(1)), F.lit(" "), F.left(b, F.lit(1)))) + ends + begins)

    return F.transform(tokens, lambda a, i: at(a, F.coalesce(F.get(tokens, i + 1), F.lit(""))))


def extract_keywords(docs: DataFrame, key: str, text: str, terms: DataFrame | TermIndex, term: str, threshold: float = THRESHOLD, measure: str = "jaccard", max_window: int = MAX_WINDOW, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with ``keywords``: the terms found, in text order without repeats, joined by a comma and a space.

    ``terms`` is a table with a column ``term``, or an index from ``open_term_index``. Texts become
    tokens once, in blocks with numbers for their distinct tokens, which are written to the shared folder.
    Only distinct normalised spans of a length that a term's partner may have meet the index, and of several
    words only those with enough grams that terms of such a length have. Spans aren't rows of a table: each
    block finds its spans again and looks up what they mean, in a broadcast up to ``MEANT_BYTES``, else in
    what a join brings it. Rows of one key share their keywords.
    """
    index = terms if isinstance(terms, TermIndex) else build_index(term_index(terms, term), threshold, measure)
    low, high, _ = _bounds(index)
    least, most = (0, 1 << 30) if measure == "overlap" else _lengths(low, high, threshold, measure)
    table = blocks.gram_table(index.probes.select("term", "n_term").distinct())
    share = LEAST_SHARE[measure](threshold) if measure in LEAST_SHARE else 0.0
    rule = blocks.span_rule(least, most, max_window, share, blocks.least_size(measure, threshold), table)
    with shuffles_deleted(docs.sparkSession):
        packed = cut_table(blocks.token_blocks(docs, key, text, tagger or ClosedClassTagger()))
        said = cut_table(blocks.span_texts(packed, rule))
        found = fuzzy_match(said, "text", index, threshold, measure, table=table).select("text", F.struct("n_term", "term").alias("_x"))
        best = cut_table(found.groupBy("text").agg(F.min("_x")["term"].alias("term")))
    n_bytes = best.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("term") + 8), F.lit(0))).first()[0]
    if n_bytes <= MEANT_BYTES:
        runs = blocks.chosen_terms(packed, rule, best)
        discard(said)
    else:
        lists = said.join(best, "text").groupBy("block").agg(F.collect_list(F.struct("text", "term")).alias("found"))
        runs = blocks.chosen_terms(packed.join(lists, "block"), rule)
    ordered = runs.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("doc", "place", "terms"))).alias("_found"))
    joined = docs.join(ordered, F.col(key) == F.col("_key"), "left")
    words = F.coalesce(ordered_distinct(F.flatten(F.transform("_found", lambda x: x["terms"]))), F.lit(""))
    return joined.withColumn("keywords", words).drop("_key", "_found")


def _lengths(low: int, high: int, threshold: float, measure: str) -> tuple[int, int]:
    """The least and greatest number of characters of a text that may be alike to terms of ``low`` to ``high`` grams; short texts are padded to one gram."""
    bounds = {"jaccard": (threshold, 1 / threshold), "dice": (threshold / (2 - threshold), (2 - threshold) / threshold), "cosine": (threshold**2, 1 / threshold**2)}[measure]
    least = ceil(low * bounds[0] - 1e-9)
    return (1 if least <= 1 else least + GRAM - 1), (floor(high * bounds[1] + 1e-9) + GRAM - 1 if high else 0)


def terms_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term): the stripped lines of a text file that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> ''")


def keywords_if_absent(docs: DataFrame, key: str, text: str, terms: DataFrame, term: str, **options) -> DataFrame:
    """``docs`` as they are if they have a column ``keywords``; else with keywords extracted."""
    return docs if "keywords" in docs.columns else extract_keywords(docs, key, text, terms, term, **options)


def given_or_extracted(docs: DataFrame, key: str, given: str, seed: int = 42, keywords: str = "keywords") -> DataFrame:
    """``docs`` whose keywords are, for about half of the keys by hash, the given ones instead; null if none are given."""
    half = F.substring(hash_order(F.col(key), seed), 1, 1) < "8"
    return docs.withColumn(keywords, F.when(half, F.col(keywords)).otherwise(F.col(given)))
