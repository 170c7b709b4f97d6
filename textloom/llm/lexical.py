r"""Ranked lexical search: an inverted index as a table of postings, and integer scores by joins and sums.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, with A-Z lower-cased
and nothing else. The index has one row for each term of each document, with a bucket by hash of
the term; a file holds the postings of one split of the documents in the order of their buckets, so
a search reads only the pages with its terms' buckets, and all postings of a document stay in one
task: scores are summed up there before anything is shuffled, and no task gets all of a common term.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, cut_table, tidy
from textloom.llm.shingles import groups, words_in

BUCKETS = 256
TOP = 20


def counted_terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The distinct terms of each text: the text's number, the term, and how often it is there."""
    low, start, stop = words_in(buf, offsets)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    edges = np.zeros(len(low) + 1, np.int32)
    edges[start] += 1
    edges[stop] -= 1
    ends = np.concatenate([[0], np.cumsum(stop - start)])
    wide = ends[-1] >= 1 << 31
    kind, size = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(size)), pa.py_buffer(low[np.cumsum(edges[:-1]) > 0])])
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets, start, side="right") - 1
    pair = text * len(coded.dictionary) + coded.indices.to_numpy()
    pair.sort()
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    terms = coded.dictionary.cast(pa.large_string() if wide else pa.string())
    return pair[new] // len(terms), terms.take(pa.array(pair[new] % len(terms))).cast(pa.string()), np.diff(np.append(new, len(pair)))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, text) -> (row, key, term, tf, n, head), where ``head`` marks one posting of each document."""
    for batch in batches:
        row, key, texts = (batch.column(i) for i in range(3))
        for lo, buf, offsets in groups(texts):
            text, term, tf = counted_terms(buf, offsets)
            if not len(text):
                continue
            n = np.bincount(text, weights=tf, minlength=len(offsets) - 1).astype(np.int64)[text]
            head = np.concatenate([[True], text[1:] != text[:-1]])
            at = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays([row.take(at), key.take(at), term, pa.array(tf), pa.array(n), pa.array(head)], ["row", "key", "term", "tf", "n", "head"])


def bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (bucket, term, key, row, tf, n, head), one row for each term of each document.

    ``tf`` is the term's occurrences and ``n`` those of all terms in the document; ``row`` tells
    rows apart that have one key; ``head`` is true once for each document. Null and empty texts, and
    those without a term, have no postings. Keys may be null, repeated and of any type; other columns
    don't matter. Nothing is shuffled: each task sorts its own postings by bucket. Write it with
    ``index.write.parquet`` to keep it.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(tidy(_postings), f"row bigint, key {kind}, term string, tf bigint, n bigint, head boolean")
    return found.select(bucket("term").alias("bucket"), "term", "key", "row", "tf", "n", "head").sortWithinPartitions("bucket")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_row, bucket, term, repeats) of the distinct terms of each item; a row is an item of its own."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.monotonically_increasing_id().alias("item_row"), F.col(key).alias("item"), words.alias("words"))
    each = rows.select("item_row", "item", F.explode("words").alias("term")).groupBy("item_row", "item", "term").agg(F.count(F.lit(1)).alias("repeats"))
    return each.withColumn("bucket", bucket("term"))


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item with a score above 0.

    With N documents that have a term, L terms in all of them, df documents with a term and tf of it
    in one of n terms, a term weighs ``floor(1000 ln((2N+2)/(2df+1)))`` and adds, for each time that
    the item has it, its weight times ``10^9 tf div (1000 tf + 12 m)``, m being
    ``75 + 25 n N div L``. Equal scores are ordered by key, nulls last. Null and empty items and
    those whose terms no document has give no row; repeated rows of either table are items and
    documents of their own. ``index`` is read three times and should be a written table.

    An item's terms and weights are broadcast if they are few enough, else joined by bucket and term,
    where skewed partitions of common terms are split; the scores are the same.
    """
    asked = cut_table(item_terms(items, item, text))
    n_asked = asked.count()
    here = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    few = n_asked <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    postings = index.filter(F.col("bucket").isin(here)) if here else index.filter(F.lit(False))
    n_docs, n_terms = index.agg(F.count_if("head"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    terms = asked.select("bucket", "term").distinct()
    df = postings.select("bucket", "term").join(sent(terms), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000.0 * F.ln(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = asked.join(df, ["bucket", "term"]).select("bucket", "term", "item_row", "item", (weight * F.col("repeats")).alias("weight")).filter("weight > 0")
    weighed = cut_table(weighed)
    share = F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L))")
    met = postings.select("bucket", "term", "key", "row", share.alias("share")).join(sent(weighed.drop("item")), ["bucket", "term"])
    scored = met.groupBy("item_row", "row", "key").agg(F.sum(F.col("weight") * F.col("share")).alias("score")).filter("score > 0")
    best = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = weighed.select("item_row", "item").distinct()
    return ranked.join(names, "item_row").select("item", "rank", "key", "score")


def search_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """``search`` over a new index of ``docs``, which is written to the shared folder and deleted with the session."""
    return search(cut_table(index_documents(docs, key, text)), items, item, text, top)
