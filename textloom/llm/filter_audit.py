r"""Audit of how filters interact: what each removes, given all orders in which they may be applied.

Each document has a mask of the filters that it fails. Counts of the masks of a part are turned, by
a zeta transform over subsets, into the survivors of every subset of filters; a step of an order
is then the difference between the survivors of two neighbouring subsets. Documents of good and of
toxic label are counted the same way.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut_table

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
#: What is counted for each mask: all documents, good ones, toxic ones.
KINDS = ("n", "good", "toxic")


def own_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 50 words), B (few distinct words), C (many capitals), D (odd characters)."""
    words = F.split(text, BLANKS)
    n, distinct = F.size(F.array_remove(words, "")), F.size(F.array_remove(F.array_distinct(words), ""))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def bits(failures: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the set of filters that they fail.

    E, to repeat the text of a smaller key, is found without joining documents to their copies:
    copies fail A to D alike, so of each text only the rows of the smallest key (all of them, if
    the key is repeated) are set apart, in each task first, and counted as not failing E; the
    others of the mask fail it. Rows with a null key repeat nothing and nothing repeats them. Null
    texts are empty texts and null parts the empty string. Of several labels of a key the greater
    counts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits(own_failures(whole)).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    keyed = narrow.filter("key IS NOT NULL").join(known, F.col("key") == F.col("label_key"), "left").drop("label_key")
    rows = cut_table(keyed.unionByName(narrow.filter("key IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})))
    summed = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS[1:]]]
    first = rows.filter("key IS NOT NULL").withColumn("place", F.rank().over(Window.partitionBy("digest").orderBy("key"))).filter("place = 1")
    alone = first.unionByName(rows.filter("key IS NULL").withColumn("place", F.lit(1)))
    every = rows.groupBy("part", "mask").agg(*summed)
    apart = alone.groupBy("part", "mask").agg(*summed)
    repeat = F.lit(1 << FILTERS.index("E"))
    repeats = every.withColumn("mask", F.col("mask") + repeat)
    less = apart.withColumn("mask", F.col("mask") + repeat).withColumns({k: -F.col(k) for k in KINDS})
    return apart.unionByName(repeats).unionByName(less).groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in KINDS])


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, good, toxic): for each part, arrays of the documents that no filter of a subset removes, by the subset's bits.

    A document passes a subset if its mask is within the complement; so counts are summed up over
    subsets, one bit at a time, and read from the end.
    """
    last = F.lit((1 << len(filters)) - 1)
    at = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS))))
    by_mask = counts.groupBy("part").agg(at.alias("at"))
    placed = lambda kind: F.transform(F.sequence(F.lit(0), last), lambda m: F.coalesce(F.col("at")[m][kind], F.lit(0).cast("long")))
    sums = by_mask.select("part", *[placed(k).alias(k) for k in KINDS])
    for b in range(len(filters)):
        below = lambda xs, bit=1 << b: F.transform(xs, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(xs, i - bit)).otherwise(F.lit(0)))
        sums = sums.withColumns({k: below(F.col(k)) for k in KINDS})
    return sums.withColumns({k: F.reverse(k) for k in KINDS})


def order_steps(passed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the arrays of ``survivors``.

    kept and removed are the documents after and at the step; redundant ones fail the filter but went
    before; unique_fails fail it alone; good_lost and toxic_lost count labels among the removed;
    shapley is what the filter removes, summed over all orders.
    """
    full = (1 << len(filters)) - 1
    n = len(filters)
    shares = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])
    lost_to = lambda bit: lambda s: F.when(s.bitwiseAND(bit) == 0, (F.get("n", s) - F.get("n", s.bitwiseOR(bit))) * F.get(shares, F.bit_count(s))).otherwise(0)
    over_all = F.transform(F.array(*[F.lit(1 << i) for i in range(n)]), lambda bit: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(full)), lost_to(bit)), F.lit(0).cast("long"), lambda a, x: a + x))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)]))
    steps = passed.withColumn("shapley", over_all).select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit_of = F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)])
    earlier = F.filter(F.split(F.col("filter_order"), ""), lambda f: F.instr("filter_order", f) < F.col("step"))
    before = F.aggregate(F.transform(earlier, lambda f: bit_of[f]), F.lit(0), lambda a, x: a + x)
    steps = steps.withColumns({"own": bit_of[letter], "before": before, "place": F.instr(F.lit(filters), letter) - 1})
    lost = lambda kind: F.get(kind, F.col("before")) - F.get(kind, F.col("before") + F.col("own"))
    return steps.withColumn("removed", lost("n")).select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.col("before") + F.col("own")).alias("kept"),
        "removed",
        (F.get("n", F.lit(0)) - F.get("n", "own") - F.col("removed")).alias("redundant"),
        (F.get("n", F.lit(full) - F.col("own")) - F.get("n", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", "place").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all parts, orders and steps.

    See ``mask_counts`` for nulls and repeated rows; an empty table has no parts, and columns other
    than those named don't matter. Whole texts are read once, by expressions; all that is shuffled
    is a key, a mask and a digest a document.
    """
    return order_steps(survivors(mask_counts(docs, labels, key, text, part)))
