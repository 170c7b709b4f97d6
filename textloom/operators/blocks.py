"""Texts as blocks of token numbers, the spans in them that may be terms, and what is chosen of those, by array operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from textloom.functions.text import normalize_text
from textloom.operators.ordering import shuffle_partitions
from textloom.operators.overlaps import free_of_overlaps
from textloom.operators.plugins import ClosedClassTagger, Tagger

#: A block ends with the sentence that brings it to so many tokens.
BLOCK_TOKENS = 1 << 19
#: Characters of normalised texts and of their padding have numbers, others share the last one.
BASE = 29
NUMBER = np.full(256, BASE - 1, np.int64)
NUMBER[1], NUMBER[ord(" ")] = 0, 27
NUMBER[ord("a") : ord("z") + 1] = np.arange(1, 27)
CLOSED, STOP, SINGLE, MARK = 1, 2, 4, 8
GRAM = 3


@dataclass(frozen=True)
class GramTable:
    """The numbered grams of an index's terms: ``keys`` (sorted; number * BASE³ + code), their hashes, in how many terms each is, and how many grams the longest such term has."""

    keys: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    longest: np.ndarray

    def longest_by_code(self) -> np.ndarray:
        out = np.zeros(BASE**GRAM, np.int64)
        np.maximum.at(out, self.keys % BASE**GRAM, self.longest)
        return out


def code_of(gram: str) -> int:
    a, b, c = (int(NUMBER[x]) for x in gram.encode())
    return (a * BASE + b) * BASE + c


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all characters, where each text begins, how long it is) of ASCII texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return NUMBER[data[offsets[0] : offsets[-1]]], offsets[:-1] - offsets[0], np.diff(offsets)


def _own_codes(numbers: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of each gram of texts; those shorter than a gram have none."""
    n = np.maximum(lengths - (GRAM - 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(begins, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (numbers[at] * BASE + numbers[at + 1]) * BASE + numbers[at + 2]


def first_grams(table: GramTable, least: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (text, n_text) of normalised texts: (text, n_text, _bits, _at, _gram), as ``keywords._first_grams`` has them, without grams that no term has, which meet nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            text = batch.column(0)
            row, code = _own_codes(*_characters(pc.utf8_rpad(text, GRAM, "\u0001")))
            key = row * BASE**GRAM + code
            order = np.argsort(key, kind="stable")
            row, code, key = row[order], code[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            places = np.arange(len(key))
            number = places - np.maximum.accumulate(np.where(new, places, 0))
            wanted = number * BASE**GRAM + code
            at = np.minimum(np.searchsorted(table.keys, wanted), max(len(table.keys) - 1, 0))
            known = table.keys[at] == wanted if len(table.keys) else np.zeros(len(wanted), bool)
            hashes = np.where(known, table.hashes[at], wanted) if len(table.keys) else wanted
            counts = np.where(known, table.counts[at], 0) if len(table.keys) else np.zeros(len(wanted), np.int64)
            order = np.lexsort((hashes, counts, row))  # rows stay together
            row, hashes, known = row[order], hashes[order], known[order]
            n = np.bincount(row, minlength=len(batch))
            begins = np.cumsum(n) - n
            bits = np.bitwise_or.reduceat(np.uint64(1) << (hashes & 63).astype(np.uint64), begins).view(np.int64)
            place = places - begins[row]
            needed = np.ceil(least(n.astype(float)) - 1e-9).astype(np.int64)
            taken = known & (place < np.minimum(n, n - needed + 1)[row])
            row = row[taken]
            yield pa.RecordBatch.from_arrays(
                [text.take(pa.array(row)), pa.array(n[row], pa.int32()), pa.array(bits[row]), pa.array(place[taken], pa.int32()), pa.array(hashes[taken])], names=["text", "n_text", "_bits", "_at", "_gram"]
            )

    return run


# Blocks -----------------------------------------------------------------------------------------


def _tag_bits(tag: Column) -> Column:
    flags = (("closed", CLOSED), ("stop", STOP), ("number", SINGLE), ("mark", MARK))
    return sum((F.when(tag[name], bit).otherwise(0) for name, bit in flags), F.lit(0))


def token_blocks(docs: DataFrame, key: str, text: str, tagger: Tagger) -> DataFrame:
    """(block, keys, docs, places, totals, lengths, codes, tags, normals): sentences in their order, as numbers of a block's distinct tokens.

    A run is what a block has of one row: its key, the row's number, the number of its first sentence
    and how many tokens it has; ``lengths`` are those of sentences. Each distinct token of a block is
    normalised and tagged once, unless the tagger may look at its neighbours: then tags are part of the token.
    """
    by_token = getattr(type(tagger), "tags", None) is ClosedClassTagger.tags
    dealt = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).repartition(shuffle_partitions(docs.sparkSession), "_key")
    sentences = dealt.withColumn("_doc", F.monotonically_increasing_id()).select("_key", "_doc", F.posexplode(tagger.sentences(F.col("_text"))).alias("_pos", "_s"))
    tokens = sentences.select("_key", "_doc", "_pos", tagger.tokens(F.col("_s")).alias("_t"))
    if not by_token:
        tagged = tokens.withColumn("_tags", tagger.tags(F.col("_t")))
        tokens = tagged.select("_key", "_doc", "_pos", F.zip_with("_t", "_tags", lambda t, g: F.concat(F.char(_tag_bits(g) + 65), t)).alias("_t"))
    kinds = {"keys": ArrayType(dealt.schema["_key"].dataType), **dict.fromkeys(("docs", "places", "totals", "lengths", "codes"), BinaryType()), "tokens": ArrayType(StringType())}
    packed = tokens.mapInArrow(_packed, StructType([StructField(*x) for x in kinds.items()]))
    bare = F.col("tokens") if by_token else F.transform("tokens", lambda t: F.substring(t, 2, 1 << 30))
    tags = F.transform(tagger.tags(F.col("tokens")), lambda g: _tag_bits(g).cast("tinyint")) if by_token else F.transform("tokens", lambda t: (F.ascii(t) - 65).cast("tinyint"))
    normals = F.transform(bare, lambda t: F.when(t.rlike("^[A-Za-z]+$"), F.lower(t)).otherwise(normalize_text(t)))
    return packed.select(F.monotonically_increasing_id().alias("block"), "keys", "docs", "places", "totals", "lengths", "codes", tags.alias("tags"), normals.alias("normals"))


def _blob(x: np.ndarray, kind: type) -> bytes:
    """Numbers as bytes: how many there are, then all first bytes, all second ones and so on, compressed."""
    planes = np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), -1).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(blob: pa.BinaryScalar, kind: type) -> np.ndarray:
    """What ``_blob`` was given."""
    held = blob.as_py()
    n, size = int.from_bytes(held[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(held[8:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, _doc, _pos, _t), a row for each sentence, to blocks."""
    names = ["keys", "docs", "places", "totals", "lengths", "codes", "tokens"]

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lengths = pc.list_value_length(table["_t"]).to_numpy().astype(np.int64)
        doc = table["_doc"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        keys = table["_key"].take(pa.array(begins)).combine_chunks()
        tokens = pc.list_flatten(table["_t"]).combine_chunks().dictionary_encode()
        rows = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
        for x, kind in ((doc[begins], np.int64), (table["_pos"].to_numpy()[begins], np.int32), (np.add.reduceat(lengths, begins), np.int32), (lengths, np.int32), (tokens.indices.to_numpy(), np.int32)):
            rows.append(pa.array([_blob(x, kind)], pa.binary()))
        rows.append(pa.ListArray.from_arrays(pa.array([0, len(tokens.dictionary)], pa.int32()), tokens.dictionary))
        return pa.RecordBatch.from_arrays(rows, names=names)

    waiting, n = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(3)), 0), 0))
        upto = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)) if len(batch) else []
        done = 0
        while done < len(batch):
            before = int(upto[done - 1]) if done else 0
            end = min(int(np.searchsorted(upto, before + BLOCK_TOKENS - n)) + 1, len(batch))
            waiting.append(batch.slice(done, end - done))
            n, done = n + int(upto[end - 1]) - before, end
            if n >= BLOCK_TOKENS:
                yield block(waiting)
                waiting, n = [], 0
    if waiting:
        yield block(waiting)


@dataclass(frozen=True)
class SpanRule:
    """Which spans may be like a term: their least and greatest number of characters and of tokens; for each number
    of grams how many a term must have (``needed``), and the share of its grams that such a term must have too.
    ``longest`` has, for each gram, how many grams the longest term with it has; None where any may be like it."""

    low: int
    high: int
    max_window: int
    needed: np.ndarray
    share: float
    longest: np.ndarray | None


def span_rule(low: int, high: int, max_window: int, share: float, least: Callable[[np.ndarray], np.ndarray], table: GramTable | None) -> SpanRule:
    sizes = np.arange(0, min(high, 1 << 20) + 1).astype(float)
    return SpanRule(max(low, 1), high, max_window, np.ceil(least(sizes) - 1e-9).astype(np.int64), share, table.longest_by_code() if table and share > 0 else None)


def _foreign(rule: SpanRule, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each word how many of its grams no term of so many grams or more has, by that number; and its last two characters, the last, the first and the first two."""
    numbers, begins, lengths = _characters(words)
    row, code = _own_codes(numbers, begins, lengths)
    most = int(rule.needed.max(initial=0))
    known = np.minimum(rule.longest[code], most)
    held = np.zeros((len(words), most + 2), np.int16)
    np.add.at(held, (row, known + 1), 1)  # a gram of terms of up to k grams is foreign from k + 1 on
    foreign = np.cumsum(held, axis=1, dtype=np.int16)
    padded = np.concatenate([numbers, [0, 0]])
    first, second = padded[begins], padded[begins + 1]
    last, before = padded[begins + np.maximum(lengths - 1, 0)], padded[begins + np.maximum(lengths - 2, 0)]
    return foreign, np.stack([before * BASE + last, last, first, first * BASE + second])


def spans_of(rule: SpanRule, lengths: np.ndarray, codes: np.ndarray, tags: np.ndarray, normals: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(start, end, text, texts): the spans of a block that may be terms, with numbers of their normalised texts."""
    encoded = normals.dictionary_encode()
    words, of_token = encoded.dictionary, encoded.indices.to_numpy()
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    word, tag = of_token[codes], tags[codes]
    empty = size[word] == 0
    ends = np.repeat(np.cumsum(lengths), lengths)
    long = np.concatenate([[0], np.cumsum(np.where(empty, 0, size[word] + 1))])
    filled = np.concatenate([[0], np.cumsum(~empty)])
    if rule.longest is not None:
        foreign, parts = _foreign(rule, words)
        space, big = int(NUMBER[ord(" ")]), 1 << 40
        a, b = word[:-1], word[1:]
        both = ~empty[:-1] & ~empty[1:]
        # for each place the longest term that has each gram at the space to the next word; no limit where there is no such gram
        joints = [
            np.where(both & (size[a] > 1), rule.longest[parts[0][a] * BASE + space], big),
            np.where(both, rule.longest[(parts[1][a] * BASE + space) * BASE + parts[2][b]], big),
            np.where(both & (size[b] > 1), rule.longest[space * BASE * BASE + parts[3][b]], big),
        ]
    begun = np.flatnonzero((tag & (CLOSED | MARK)) == 0)
    starts, stops = [], []
    for length in range(1, rule.max_window + 1):
        i = begun[begun + length <= ends[begun]]
        good = (tag[i + length - 1] & CLOSED) == 0
        if length == 1:
            good &= (tag[i] & (STOP | SINGLE)) == 0
        characters = long[i + length] - long[i] - 1
        good &= (characters >= rule.low) & (characters <= rule.high)
        i, characters = i[good], characters[good]
        if rule.longest is not None and length > 1:
            n = np.maximum(characters - (GRAM - 1), 1)
            several = filled[i + length] - filled[i] > 1
            kept, i_s, n_s = i[~several], i[several], n[several]
            need = rule.needed[n_s]
            away = sum(foreign[word[i_s + q], need].astype(np.int64) for q in range(length))
            away = away + sum((x[i_s + q] < need).astype(np.int64) for q in range(length - 1) for x in joints)
            i = np.sort(np.concatenate([kept, i_s[away <= (1 - rule.share) * n_s + 1e-9]]))
        starts.append(i)
        stops.append(i + length)
    start, end = np.concatenate(starts), np.concatenate(stops)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    n = filled[end] - filled[start]
    places = np.flatnonzero(~empty)  # of words, in their order
    text = word[places[filled[start]]].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    several = np.flatnonzero(n > 1)
    if not len(several):
        return start, end, text, words
    at, k = filled[start[several]], n[several]
    rows = np.full((len(several), rule.max_window), -1, np.int32)
    for q in range(rule.max_window):
        rows[k > q, q] = word[places[at[k > q] + q]]
    distinct, number = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    names = words.to_pylist()
    joined = [" ".join(names[w] for w in r if w >= 0) for r in distinct.view(np.int32).reshape(len(distinct), -1).tolist()]
    text[several] = len(words) + number.ravel()
    return start, end, text, pa.concat_arrays([words, pa.array(joined, words.type)])


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """What ``spans_of`` takes, of one block."""
    of = lambda name, kind: _numbers(batch.column(name)[i], kind)
    return of("lengths", np.int32).astype(np.int64), of("codes", np.int32), batch.column("tags")[i].values.to_numpy(), batch.column("normals")[i].values


def span_texts(blocks: DataFrame, rule: SpanRule) -> DataFrame:
    """(block, text): the distinct texts of a block's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                _, _, text, texts = spans_of(rule, *_opened(batch, i))
                used = texts.take(pa.array(np.unique(text)))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("block")[i], len(used)), used.cast(pa.string())], names=["block", "text"])

    return blocks.select("block", "lengths", "codes", "tags", "normals").mapInArrow(run, "block bigint, text string")


def _chosen(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans, sorted by their starts, are chosen; those that meet no other are without a further look."""
    if not len(start):
        return np.zeros(0, bool)
    alone = np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]]) & np.concatenate([end[:-1] <= start[1:], [True]])
    rest = np.flatnonzero(~alone)
    alone[rest] = free_of_overlaps(np.zeros(len(rest), np.int8), start[rest], end[rest])
    return alone


def chosen_terms(blocks: DataFrame, rule: SpanRule, meant: DataFrame | None = None) -> DataFrame:
    """(_key, doc, place, terms): the terms of each run in text order without repeats, of the greedy choice of spans that share no token.

    ``meant`` is (text, term) of what spans' texts mean, which goes to all workers; without it, ``blocks``
    have ``found``, those of their own spans. Spans lie within sentences, so
    each block is resolved by itself, as in ``resolve_overlaps``.
    """

    sent = None
    if meant is not None:
        table = meant.select("text", "term").toArrow().combine_chunks()
        whole = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns]
        sent = blocks.sparkSession.sparkContext.broadcast((whole[0], whole[1].dictionary_encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                of = lambda name, kind: _numbers(batch.column(name)[i], kind)  # noqa: E731, B023
                start, end, text, texts = spans_of(rule, *_opened(batch, i))
                if sent:
                    known, terms = sent.value
                else:
                    found = batch.column("found")[i].values
                    known, terms = found.field("text"), found.field("term").dictionary_encode()
                place = pc.fill_null(pc.index_in(texts, known.cast(texts.type)), -1).to_numpy()
                term = np.where(place >= 0, np.append(terms.indices.to_numpy(), -1)[place], -1)[text]
                start, end, term = start[term >= 0], end[term >= 0], term[term >= 0]
                kept = _chosen(start, end)
                totals = of("totals", np.int32).astype(np.int64)
                owner = np.searchsorted(np.cumsum(totals), start[kept], side="right")
                _, first = np.unique(owner * (len(terms.dictionary) + 1) + term[kept], return_index=True)
                first.sort()
                owner, term = owner[first], term[kept][first]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(totals)))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), terms.dictionary.take(pa.array(term)))
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(of("docs", np.int64)), pa.array(of("places", np.int32)), lists], names=["_key", "doc", "place", "terms"])

    kinds = {"_key": blocks.schema["keys"].dataType.elementType, "doc": LongType(), "place": IntegerType(), "terms": ArrayType(StringType())}
    return blocks.mapInArrow(run, StructType([StructField(*x) for x in kinds.items()]))


def least_size(measure: str, threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """The least size of the other set, for sizes."""
    share = {"jaccard": threshold, "dice": threshold / (2 - threshold), "cosine": threshold * threshold, "overlap": 0.0}[measure]
    return lambda n: n * share


def gram_rows(terms: DataFrame) -> DataFrame:
    """(gram, number, hash, n, longest) of distinct (term, n_term): the grams of normalised texts that terms have, numbered as in ``keywords.char_grams``."""
    padded = F.rpad("term", F.greatest(F.length("term"), F.lit(GRAM)), "\u0001")
    grams = terms.select("n_term", padded.alias("_p")).select("n_term", F.sort_array(F.transform(F.sequence(F.lit(1), F.length("_p") - (GRAM - 1)), lambda i: F.substring(F.col("_p"), i, F.lit(GRAM)))).alias("_g"))
    each = grams.select("n_term", F.explode(F.transform("_g", lambda g, i: F.struct(g.alias("gram"), (i - F.array_position("_g", g).cast("int")).alias("number")))).alias("x"))
    rows = each.groupBy("x.gram", "x.number").agg(F.count(F.lit(1)).alias("n"), F.max("n_term").alias("longest"))
    return rows.filter(F.col("gram").rlike("^[a-z \u0001]{3}$")).select("gram", "number", F.xxhash64("gram", "number").alias("hash"), "n", "longest")


def gram_table(terms: DataFrame, most: int = 1 << 17) -> GramTable | None:
    """The table of the terms' grams; None if there are more than ``most``."""
    rows = gram_rows(terms).limit(most + 1).collect()
    if len(rows) > most:
        return None
    keys = np.array([(r["number"] + 1) * BASE**GRAM + code_of(r["gram"]) for r in rows], np.int64)
    order = np.argsort(keys)
    of = lambda name: np.array([r[name] for r in rows], np.int64)[order]
    return GramTable(keys[order], of("hash"), of("n"), of("longest"))
