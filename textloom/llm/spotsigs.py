"""Document fingerprints from spot signatures, with DataFrame functions only.

A spot signature is a common word (an anchor) and the content words after it, so it follows the
running text and not what is around it. Anchors are function words of four languages and the words
that most documents have, so that texts of other languages and kinds have anchors too. A document's
fingerprint is the set of its signatures. Sets are partitioned by their length and compared by Jaccard similarity: sets of too different
sizes cannot be alike, and sets that are alike share a signature among the first few in any common
order, which prunes the search for near duplicates.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from textloom.llm.common import cut, cut_table, discard, shuffle_partitions

# Function words of English, German, French and Spanish, a choice of our own; they start a signature and are in no chain.
ANCHORS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "als", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu", "au", "avec", "dans", "des", "du", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une", "al", "con", "de", "del", "el", "en", "las", "los", "no", "para", "por", "se", "su", "una", "y")
#: A chain has so many content words, or fewer where the next anchor follows.
CHAIN = 2
#: So many of the words that most documents have are anchors too; they may be in the chain of an anchor before them.
COMMON_WORDS = 256
#: Likeness below this counts as none, so sets of too different lengths need no comparison.
LEAST_LIKE = 0.05
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Stand in front of function words and of other common words while chains are looked for.
MARK, COMMON_MARK = "\u0001", "\u0002"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def common_words(docs: DataFrame, text: str = "text", most: int = COMMON_WORDS) -> tuple[str, ...]:
    """The ``most`` words that most documents have, each in two or more and none a function word; ties by the word.

    Words are counted over all documents, summed up in each task before they are shuffled; what
    comes to the driver is ``most`` words.
    """
    words = docs.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & ~F.col("word").isin(*ANCHORS))
    return tuple(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect())


def marked_words(text: Column, common: tuple[str, ...] = (), anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The words between spaces, with a mark in front of function words and another in front of common ones."""
    mark = lambda w: F.when(w.isin(*anchors), F.concat(F.lit(MARK), w))
    soft = lambda w: mark(w).when(w.isin(*common), F.concat(F.lit(COMMON_MARK), w)) if common else mark(w)
    return F.array_join(F.transform(words_of(text), lambda w: soft(w).otherwise(w)), " ")


def signatures_of(marked: str, chain: int = CHAIN) -> Column:
    """The sorted set of hashes of the spot signatures in the column ``marked``, as ``marked_words`` gives it.

    A signature is an anchor and the words that follow it, up to ``chain`` and up to the next
    function word; of several function words in a row the last one counts. Each anchor has its own,
    so chains may overlap. Where that gives none, all words are one signature. So only a text
    without words has the empty set.
    """
    own = F.col(marked)
    # The chain is in a look-ahead, so that the next match may begin inside it.
    spots = F.regexp_extract_all(own, F.lit(rf"[{MARK}{COMMON_MARK}](?=([^ ]+(?: [^ {MARK}]+){{1,{chain}}}))"), F.lit(1))
    hashed = F.transform(spots, lambda s: F.xxhash64(s))
    some = F.aggregate(F.array(hashed), F.array().cast("array<bigint>"), lambda _, found: F.when(F.size(found) > 0, found).otherwise(F.array(F.xxhash64(F.lit("whole"), own))))
    return F.sort_array(F.array_distinct(F.when(own == "", F.array().cast("array<bigint>")).otherwise(some)))


def with_signatures(docs: DataFrame, text: Column, into: str, common: tuple[str, ...] = (), chain: int = CHAIN) -> DataFrame:
    """Adds ``into``, the sorted set of signatures of ``text``."""
    words = f"_{into}_words"
    return docs.withColumn(words, marked_words(text, common)).withColumn(into, signatures_of(words, chain)).drop(words)


def length_partition(signatures: str, least: float) -> Column:
    """Sets that are at least ``least`` alike are in the same partition or in neighbouring ones; -1 for empty sets."""
    return F.when(F.size(signatures) == 0, -1).otherwise(F.floor(F.log(F.size(signatures)) / F.lit(math.log(1 / least)))).cast("int")


def jaccard(a: str, b: str, least: float = LEAST_LIKE) -> Column:
    """Jaccard similarity of two sorted sets, or 0 where it is below ``least``; 1 for two empty ones.

    Sets are compared only if their length partitions are neighbours, their sizes allow it, and
    they share one of the first signatures that sets so alike must share.
    """
    n_a, n_b = F.size(a), F.size(b)
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    near = F.abs(length_partition(a, least) - length_partition(b, least)) <= 1
    first = lambda c, n: F.slice(F.col(c), F.lit(1), n - F.ceil(n * F.lit(least)).cast("int") + 1)
    meets = F.arrays_overlap(first(a, n_a), first(b, n_b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (n_a + n_b - shared)
    return F.when(large == 0, 1.0).when((small == 0) | ~near | (small < large * F.lit(least)), 0.0).when(~meets, 0.0).when(exact < least, 0.0).otherwise(exact)


def fingerprint(signatures: str) -> Column:
    """The sorted set as a string, 16 hexadecimal digits a signature, so that likeness can be told from two of them."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", common: tuple[str, ...] | None = None) -> DataFrame:
    """(key, n_signatures, signatures, fingerprint, set_id) of each whole text; null texts are empty.

    ``common`` are the anchors beside the function words, those of ``docs`` if not given; give the
    same ones for fingerprints that are to be compared between tables. ``set_id`` is a digest of
    the fingerprint.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = with_signatures(own, F.col("text"), "signatures", common_words(own) if common is None else common)
    named = found.withColumn("fingerprint", fingerprint("signatures"))
    return named.select(F.col("key").alias(key), F.size("signatures").alias("n_signatures"), "signatures", "fingerprint", F.sha2("fingerprint", 256).alias("set_id"))


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", n_parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next text.

    The next document is that with the next smaller key (after the last one, the first; null keys
    come last, repeated keys go by a hash of their text). The edited text has its last third
    (rounded down, in code points) replaced by as many code points from the next text's begin, or
    all it has. A single document is its own next one. Null texts are empty; two empty sets are
    alike. Keys are of any type that has an order; other columns don't matter.

    Rows are dealt into ranges of (key, hash of the text), so no task sees all, whatever keys
    repeat or are missing; only equal rows stay together. What follows a range's last row comes
    from a table with the first row of each range.
    """
    spark = docs.sparkSession
    n = n_parts or shuffle_partitions(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.struct(F.col("key").isNotNull().alias("there"), F.col("key").alias("key"), F.md5("text").alias("digest"))
    placed = rows.withColumn("place", place)
    common = common_words(rows)
    tops = range_tops(placed, n)
    dealt = placed.withColumn("part", place_among(F.col("place"), tops, placed.schema["place"].dataType)).repartition(shuffle_partitions(spark), "part")
    signed = with_signatures(dealt.withColumn("n_chars", F.length("text").cast("long")), F.col("text"), "signatures", common)
    led = signed.withColumn("next", F.lead(F.struct("text", "signatures")).over(Window.partitionBy("part").orderBy(F.col("place").desc())))
    firsts = with_signatures(first_of_next(placed.withColumn("part", place_among(F.col("place"), tops, placed.schema["place"].dataType))), F.col("_text"), "_signatures", common)
    after = led.join(firsts, F.col("part") == F.col("_part"))
    merged = after.select("key", "text", "n_chars", "signatures", F.coalesce("next.text", "_text").alias("following"), F.coalesce("next.signatures", "_signatures").alias("next_signatures"))
    third = "cast(n_chars div 3 as int)"
    edited = F.concat(F.expr(f"substring(text, 1, cast(n_chars as int) - {third})"), F.expr(f"substring(following, 1, {third})"))
    both = with_signatures(merged.withColumn("edited", edited).drop("text", "following"), F.col("edited"), "edited_signatures", common)
    return both.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("signatures").alias("fingerprint"), fingerprint("edited_signatures").alias("edited_fingerprint"),
        jaccard("signatures", "edited_signatures").alias("near_edited"), jaccard("signatures", "next_signatures").alias("near_next"),
    )


def range_tops(placed: DataFrame, n: int) -> list[dict]:
    """The greatest ``place`` of each of about ``n`` ranges, as Spark's own range partitioning finds them, in falling order."""
    ends = placed.select("place").repartitionByRange(n, F.col("place").desc()).groupBy(F.spark_partition_id().alias("p")).agg(F.max("place").alias("top"))
    return json.loads(ends.agg(F.to_json(F.sort_array(F.collect_list("top"), asc=False))).first()[0])


def place_among(place: Column, tops: list[dict], kind: DataType) -> Column:
    """How many of ``tops``, in falling order, are at least ``place``; 0 to 1 above the last. Found in two steps of about the root of their number.

    They are one literal in the plan, however many there are.
    """
    if not tops:
        return F.lit(0)
    step = max(1, math.isqrt(len(tops)))
    literal = lambda some: F.from_json(F.lit(json.dumps(some)), ArrayType(kind))
    coarse = F.size(F.filter(literal(tops[::step]), lambda t: t >= place))
    near = F.slice(literal(tops), F.greatest((coarse - 1) * step + 1, F.lit(1)), F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(near, lambda t: t >= place)))


def first_of_next(rows: DataFrame) -> DataFrame:
    """For each range that has rows, the text after its last row: the first of the next range, in a circle."""
    ends = cut(rows.groupBy("part").agg(F.max_by("text", "place").alias("text")))
    circle = Window.orderBy("part")
    every = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ends.select(F.col("part").alias("_part"), F.coalesce(F.lead("text").over(circle), F.first("text").over(every)).alias("_text"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): ``set_id`` of fingerprints whose signature sets are at least ``threshold`` alike.

    Texts with one fingerprint are one node; ``fingerprints`` has the members. Two sets can only
    be alike if the smaller has ``threshold`` of the larger's size, so sets are partitioned by the
    logarithm of their length and meet in their own and the next partition. Two sets that are
    alike share one of their first ``n - ceil(threshold * n) + 1`` signatures, rarest first, so
    they meet at such a signature. There, all are compared with the first; those that are not
    linked to it are compared with all others. So two texts that are alike are linked, if not
    directly then through the first, and a group of copies costs one comparison a copy.

    Null and empty texts and texts without words have no signatures and are in no pair. Repeated
    rows, ids and texts share a fingerprint; null ids, and columns of any name, don't matter.
    """
    sets = cut(fingerprints(docs, key, text).filter("n_signatures > 0").groupBy("set_id").agg(F.any_value("signatures").alias("signatures")))
    spread = sets.select("set_id", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    counts = spread.groupBy("signature").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(counts, "signature").groupBy("set_id").agg(F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "signature"))).alias("all"))
    prefix = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold)).cast("int") + 1)
    length = F.floor(F.log("n") / F.lit(math.log(1 / threshold)))
    meets = ranked.select("set_id", length.alias("length"), F.explode(F.transform(prefix, lambda x: x["signature"])).alias("signature"))
    homes = meets.select("set_id", F.explode(F.array(F.struct(F.col("length").alias("at"), F.lit(True).alias("home")), F.struct((F.col("length") + 1).alias("at"), F.lit(False).alias("home")))).alias("place"), "signature")
    members = cut(homes.select("set_id", "place.home", F.xxhash64("place.at", "signature").alias("bucket")))
    leaders = members.groupBy("bucket").agg(F.min(F.when(F.col("home"), F.col("set_id"))).alias("leader"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and leader is not null").drop("_n")
    led = cut(members.join(leaders, "bucket"))
    stars = compared(led.filter("set_id <> leader").select(F.col("set_id").alias("a"), F.col("leader").alias("b")).distinct(), sets, threshold)
    stars = cut(stars)
    outside = led.filter("set_id <> leader").join(stars.select(F.col("a").alias("set_id"), F.col("b").alias("leader")), ["set_id", "leader"], "left_anti")
    one = outside.select("bucket", F.col("set_id").alias("a"), F.col("home").alias("home_a"))
    two = led.select("bucket", F.col("set_id").alias("b"), "home", "leader")
    others = one.join(two, "bucket").filter((F.col("a") != F.col("b")) & (F.col("home") | F.col("home_a")) & (F.col("b") != F.col("leader")))
    rest = compared(others.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets, threshold)
    found = stars.union(rest)
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are at least ``threshold`` alike."""
    one = sets.select(F.col("set_id").alias("a"), F.col("signatures").alias("_sa"))
    two = sets.select(F.col("set_id").alias("b"), F.col("signatures").alias("_sb"))
    scored = pairs.join(one, "a").join(two, "b").withColumn("similarity", jaccard("_sa", "_sb", threshold))
    return scored.filter(F.col("similarity") >= threshold).select("a", "b", "similarity")
