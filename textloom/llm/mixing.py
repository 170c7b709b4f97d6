"""Mixing sources to target weights by systematic sampling.

Within a source, documents are put in an order, their expected copies are summed up along it, one
random offset is added, and a document is emitted once for each integer that the sum crosses at
it. The order is by size, so the words taken from a source differ from its target by about one
document's size at most; of a few offsets, drawn by hash, the first that comes near the target is
the source's, or else the nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, cut_table, free_name, ordinal_within, sheltered, spread_join, unit_interval, unsheltered

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: So many offsets are drawn for each source, and so near the target the first of them has to come.
OFFSETS, NEAR = 16, 0.01


def n_words(text: Column | str) -> Column:
    r"""The number of matches of ``[^\x20\x09-\x0D]+``; 0 for null."""
    marked = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(marked, "[^x]+", "")).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size): weights by rank of the source, with a ceiling.

    What is above ``most`` times a source's size goes to the others by weight until none is above.
    The level of the shares is found by sums over the table, one for each round.
    """
    one = free_name(sizes, "_all")
    ranked = ordinal_within(sizes.withColumn(one, F.lit(1)), one, [F.col(source).asc_nulls_last()], [source, "source_size"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("ordinal") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select(source, "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("ceiling")))
    total, weighed = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    goal, level, above = share * total, share * total / weighed if weighed else 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("ceiling")
        n, held, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("ceiling")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == above or not free:
            break
        above, level = n, (goal - held) / free
    return ranked.select(source, "source_size", F.when(over, F.col("ceiling")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to each document.

    The sources, by code point and null last, weigh ``weights`` in turn. ``share`` times all words
    are asked for; no source gives more than ``most`` times its own, so no document is taken more
    than ``ceil(most)`` times. Null and empty texts have size 0 and may be taken, which adds no
    words. Documents of equal size are ordered by a hash of the key, then the key; rows that agree
    in all of this are alike, whichever is taken. Reruns agree. ``keep`` names the columns to
    return beside the new ones (all by default); columns named like new ones are replaced, all others
    pass through, whatever their names.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    columns = [c for c in (keep or docs.columns) if c not in new]
    sized = sheltered(docs.select(*dict.fromkeys([*columns, source, key, text])), tuple({source, key, text} - set(columns)), source=F.col(source), key=F.col(key), hash=F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), size=n_words(text))
    if text not in columns:  # narrow rows are written, so that words are counted once
        sized = cut_table(sized)
    ranked = ordinal_within(sized, "source", [F.col("size"), F.col("hash"), F.col("key")], ["row", "key", "size", "hash"])
    sizes = cut(ranked.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_sources = sizes.count()
    targets = source_targets(sizes, "source", weights, share, most).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    counted = targets.withColumn("rate", rate)
    crossed = lambda u, k: F.floor(u + (F.col("ordinal") - k) * F.col("rate"))
    copies = lambda u: (crossed(u, 0) - crossed(u, 1)).cast("int")
    drawn = [unit_interval(seed, F.col("of_source"), str(k)) for k in range(OFFSETS)]
    offered = cut(counted.select("of_source", "source_size", "target", "rate", F.array(*drawn).alias("offsets")))
    tried = spread_join(ranked, offered, "source", "of_source", n_sources, F.col("ordinal"))
    words = tried.groupBy("of_source").agg(*[F.sum(copies(F.col("offsets")[k]) * F.col("size")).alias(f"words_{k}") for k in range(OFFSETS)])
    off = lambda k: F.abs(F.col(f"words_{k}") - F.col("target"))
    tries = F.array(*[F.struct(F.when(off(k) <= F.col("target") * NEAR, 0.0).otherwise(off(k)).alias("off"), F.lit(k).alias("k"), F.col("offsets")[k].alias("offset")) for k in range(OFFSETS)])
    words = words.withColumnRenamed("of_source", "tried")
    chosen = cut(offered.join(words, F.col("of_source").eqNullSafe(F.col("tried"))).select("of_source", "source_size", "target", "rate", F.array_min(tries)["offset"].alias("offset")))
    joined = spread_join(ranked, chosen, "source", "of_source", n_sources, F.col("ordinal"))
    return joined.withColumn("copies", copies(F.col("offset"))).select(*unsheltered(columns), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
