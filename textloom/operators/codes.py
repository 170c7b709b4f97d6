"""Code dictionaries and random code sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text, parse_literal_list, split_words
from textloom.operators.keywords import bound
from textloom.operators.ordering import hash_order, small, with_ordinal


def code_terms(dictionary: DataFrame, code: str, term: str, ordinal: str) -> DataFrame:
    """(code, terms): each code's terms in the order of the dictionary."""
    grouped = dictionary.groupBy(F.col(code).alias("code")).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("at"), F.col(term).alias("term")))).alias("rows"))
    return grouped.select("code", F.transform("rows", lambda x: x["term"]).alias("terms"))


def lookup_terms(df: DataFrame, codes: str, terms: DataFrame) -> DataFrame:
    """One row for each code between white space that the dictionary has, with ``code`` and ``terms``."""
    each = df.withColumn("code", F.explode(split_words(codes)))
    return each.join(terms, "code")


def code_numbers(codes: DataFrame, code: str) -> DataFrame:
    """(code, number): the distinct codes, numbered from 0 in their order."""
    return with_ordinal(codes.select(F.col(code).alias("code")).distinct(), F.col("code")).select("code", (F.col("ordinal") - 1).cast("int").alias("number"))


def encode_codes(df: DataFrame, key: str, codes: str, numbers: DataFrame) -> DataFrame:
    """(key, numbers): the codes of each row as numbers joined by spaces; an unknown code is an error."""
    each = df.select(F.col(key), F.posexplode(split_words(codes)).alias("pos", "code"))
    found = each.join(numbers, "code", "left").withColumn("number", F.coalesce(F.col("number"), F.raise_error(F.concat(F.lit("unknown code "), F.col("code"))).cast("int")))
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda x: x["number"].cast("string")), " ").alias("numbers"))


def originals_of(terms: DataFrame, term: str, ordinal: str) -> DataFrame:
    """(normal, originals): a reverse dictionary, the terms that have one normal form, in the order of ``ordinal``."""
    rows = terms.select(normalize_text(term).alias("normal"), F.struct(F.col(ordinal).alias("at"), F.col(term).alias("term")).alias("x")).distinct()
    grouped = rows.groupBy("normal").agg(F.array_sort(F.collect_list("x")).alias("rows"))
    return grouped.select("normal", F.array_distinct(F.transform("rows", lambda x: x["term"])).alias("originals"))


def original_keywords(df: DataFrame, key: str, keywords: str, originals: DataFrame, normal: str, original: str, ordinal: str) -> DataFrame:
    """(key, originals): list literals of normalised keywords, each replaced by the first original with that form."""
    first = originals.groupBy(F.col(normal).alias("_normal")).agg(F.min_by(original, ordinal).alias("_original"))
    each = df.select(F.col(key), F.posexplode_outer(parse_literal_list(keywords)).alias("pos", "word")).join(first, F.col("word") == F.col("_normal"), "left")
    known = F.when(F.col("word").isNotNull(), F.coalesce("_original", F.raise_error(F.concat(F.lit("unknown keyword "), F.col("word"))).cast("string")))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", known.alias("original"))))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda x: x["original"]), ", ").alias("originals"))


def draw(seed: int, n: Column | int, *parts: Column | str) -> Column:
    """A number from 1 to ``n``, by an md5 over the parts and the seed."""
    text = F.concat_ws("~", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (value % (F.lit(n) if isinstance(n, int) else n) + 1).cast("int")


#: Dictionaries of at most so many codes are ranked whole for each sample; of larger ones, codes are drawn by number.
FEW_CODES = 64


def random_code_sets(samples: DataFrame, sample: str, terms: DataFrame, max_codes: int, max_terms: int, seed: int) -> DataFrame:
    """(sample, codes, n_codes, keywords, n_kws): random codes for each sample, and terms of each.

    A sample draws its number of codes and, once for all of them, its number of terms; codes and
    terms are the first in hash order, without repeats. Each sample draws numbers of codes, more
    than it needs, and takes the first different ones; they meet the dictionary in a join on the
    number. A dictionary of few codes goes with every sample instead. Samples without terms are
    dropped.
    """
    wanted = samples.select(F.col(sample).alias("sample"), draw(seed, max_codes, "n", F.col(sample)).alias("_codes"), draw(seed, max_terms, "k", F.col(sample)).alias("_terms"))
    numbered = code_numbers(terms, "code").join(terms.select(F.col("code").alias("_code"), "terms"), F.col("code") == F.col("_code")).drop("_code")
    n = numbered.count()
    if n <= max(FEW_CODES, 2 * max_codes):
        few = F.array(*[F.lit(r["code"]) for r in numbered.select("code").collect()]) if n else F.array().cast("array<string>")
        hashed = F.array_sort(F.transform(few, lambda c: F.struct(F.md5(F.concat_ws("~", F.col("sample").cast("string"), c, F.lit(str(seed)))).alias("h"), c.alias("code"))))
        chosen = wanted.select("sample", "_terms", F.posexplode(F.slice(hashed, F.lit(1), F.col("_codes"))).alias("_rank", "x")).select("sample", "_terms", "_rank", F.col("x.code").alias("code"))
        return _assemble(chosen.join(terms.select("code", "terms"), "code"), seed)
    draws = F.transform(F.sequence(F.lit(1), F.lit(4 * max_codes + 16)), lambda k: draw(seed, n, "code", F.col("sample"), k) - 1)
    numbers = F.slice(F.array_distinct(draws), F.lit(1), F.col("_codes"))
    drawn = wanted.withColumn("_numbers", numbers).select("sample", "_terms", F.posexplode("_numbers").alias("_rank", "_number"))
    return _assemble(drawn.join(numbered, F.col("_number") == F.col("number")), seed)


def associated_code_sets(samples: DataFrame, sample: str, principal: str, associated: str, terms: DataFrame, max_codes: int, max_terms: int, seed: int) -> DataFrame:
    """Like ``random_code_sets``, from a principal code and some of those associated with it.

    ``n_codes`` doesn't count the principal one. Without associated codes, none are drawn; codes
    that the dictionary lacks are passed over.
    """
    own = samples.select(F.col(sample).alias("sample"), F.col(principal).alias("_principal"), split_words(associated).alias("_others"))
    most = F.least(F.lit(max_codes), F.size("_others"))
    own = own.withColumn("_codes", F.when(most > 0, draw(seed, F.greatest(most, F.lit(1)), "n", F.col("sample"))).otherwise(0)).withColumn("_terms", draw(seed, max_terms, "k", F.col("sample")))
    hashed = F.transform("_others", lambda x, pos: F.struct(hash_order(F.concat_ws("~", F.col("sample").cast("string"), pos.cast("string")), seed).alias("h"), pos.alias("pos"), x.alias("code")))
    others = F.transform(F.slice(F.sort_array(hashed), F.lit(1), F.col("_codes")), lambda x: x["code"])
    chosen = own.select("sample", "_codes", "_terms", F.posexplode_outer(F.concat(F.array("_principal"), others)).alias("_rank", "code"))
    few = small(terms, terms.count())
    return _assemble(chosen.filter("sample IS NOT NULL").join(few, "code"), seed, F.first("_codes"))


def _assemble(chosen: DataFrame, seed: int, n_codes: Column | None = None) -> DataFrame:
    """Puts codes and their drawn terms together, in the order of their ranks; ``n_codes`` is an aggregate to have in place of their number."""
    before = F.concat_ws("~", F.col("sample").cast("string"), F.col("code"))
    hashed = lambda x: F.transform("terms", lambda t: F.struct(F.md5(F.concat_ws("~", x, t, F.lit(str(seed)))).alias("h"), t.alias("t")))
    picked = F.transform(F.slice(F.sort_array(bound(before, hashed, "struct<h:string,t:string>")), F.lit(1), F.col("_terms")), lambda x: x["t"])
    rows = chosen.withColumn("_picked", picked)
    grouped = rows.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("_rank", "code", "_picked"))).alias("rows"), (n_codes if n_codes is not None else F.count(F.lit(1)).cast("int")).alias("n_codes"))
    words = F.flatten(F.transform("rows", lambda x: x["_picked"]))
    out = grouped.select("sample", F.array_join(F.transform("rows", lambda x: x["code"]), " ").alias("codes"), "n_codes", F.array_join(words, ", ").alias("keywords"), F.size(words).alias("n_kws"))
    return out.filter("n_kws > 0")
