"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Items and documents are cut into words. Each word of the items is one symbol; each window of an
item's consecutive words is one pattern over symbols; all patterns share one automaton. Documents
become a string of symbols (one stands for all other words and for the ends of texts), which is
scanned once; places in it are words, and so map to offsets in the original text. Words are looked
up by 64-bit hashes for many texts at once; where the automaton hits, their bytes are compared.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from textloom.llm.common import cut_table, discard, free_name, tidy
from textloom.llm.shingles import Hasher, groups, words_in

WINDOW = 13
#: A block of items holds at most so many windows; its automaton is what is broadcast.
BLOCK_WINDOWS = 200_000
#: On lower-cased UTF-8: digits, a-z, and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands for words that no item has.
UNKNOWN = "\0"


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(raw.lower())  # bytes.lower() changes A-Z only


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; of a shorter list, the whole of it; none of an empty one."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def blocks_of(benchmark: DataFrame, item: str, text: str, size: int, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most ``most`` windows (or one item each), read partition by partition."""
    block: list[tuple[object, list[bytes]]] = []
    n = 0
    for row in benchmark.select(item, text).toLocalIterator():
        words = words_of(row[1])
        new = len(windows_of(words, size)) if words else 0
        if block and n + new > most:
            yield block
            block, n = [], 0
        if words:
            block.append((row[0], words))
            n += new
    yield block


def hash_words(low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return Hasher(low).of(start, stop)


class Scanner:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int) -> None:
        every = list({w: None for _, words in items for w in words})
        ends = np.cumsum([0] + [len(w) for w in every])
        hashes = hash_words(np.frombuffer(b"".join(every), np.uint8), ends[:-1], ends[1:]) if every else np.zeros(0, np.uint64)
        # One symbol a hash, so that words with one hash are told apart by their bytes only.
        self.hashes, at = np.unique(hashes, return_inverse=True)
        codes = np.arange(1, len(self.hashes) + 1)
        self.codes = np.where(codes < 0xD800, codes, codes + 0x800).astype("<u4")
        symbols = {w: chr(c) for w, c in zip(every, self.codes[at].tolist(), strict=True)}
        # By pattern: the items that have it, each with the place of its words; one for each different window.
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            for window, place in {w: i for i, w in enumerate(windows_of(words, size))}.items():
                owners.setdefault("".join(symbols[w] for w in window), []).append((k, place))
        self.items, self.words = [i for i, _ in items], [words for _, words in items]
        self.automaton = ahocorasick.Automaton()
        for pattern, own in owners.items():
            self.automaton.add_word(pattern, (len(pattern), own))
        self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: np.ndarray, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict[int, list[tuple[int, int, object]]]:
        """By the text's number: (first word, last word, item) of each maximal run of an item's windows.

        ``text``, ``start`` and ``stop`` are those of each word in ``low``, in order; places count
        the words of all texts.
        """
        if self.empty or not len(start):
            return {}
        hashes = hash_words(low, start, stop)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.codes[at], ord(UNKNOWN)).astype("<u4")
        # A mark between texts: the n-th word stands at n plus its text's number.
        string = np.full(len(found) + int(text[-1]) + 1, ord(UNKNOWN), "<u4")
        string[np.arange(len(found)) + text] = found
        places = np.arange(len(text)) + text
        out: dict[int, list[tuple[list[int], int]]] = {}
        last: dict[tuple[int, int], list[int]] = {}
        seen: dict[int, bytes] = {}
        for end, (n, own) in self.automaton.iter(string.tobytes().decode("utf-32-le")):
            final = int(np.searchsorted(places, end))
            first = final - n + 1
            t = int(text[first])
            for i in range(first, final + 1):
                if i not in seen:
                    seen[i] = low[start[i] : stop[i]].tobytes()
            here = [seen[i] for i in range(first, final + 1)]
            for k, place in own:
                if self.words[k][place : place + n] != here:
                    continue
                held = last.get((t, k))
                if held and first <= held[1]:  # overlaps the run before
                    held[1] = final
                else:
                    last[t, k] = held = [first, final]
                    out.setdefault(t, []).append((held, k))
        return {t: [(a, b, self.items[k]) for (a, b), k in found] for t, found in out.items()}


#: The automaton of this Python worker, by the block's tag.
_scanners: dict[str, Scanner] = {}

HIT = StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("item", StringType())])
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` and ``spans`` to each document.

    A word inside any occurrence of any window of ``size`` consecutive words of an item is hit;
    ``items`` has the ids of the items concerned, as strings in order, ``spans`` the hit stretches
    of the original text in code points. Null and empty texts, and items without words, have no
    words and hit nothing; a repeated item or one with a null id counts like any other, the null
    id by the empty string. Columns named like new ones are replaced; other columns and repeated
    rows pass through.

    The items are read in blocks of bounded size, and each block's automaton is built where it is
    used. One block is the usual case and needs one pass; between passes over several, the
    documents and their hits so far are written to the shared folder.
    """
    new = ("n_words", "n_hit", "items", "spans")
    columns = [c for c in docs.columns if c not in new]
    narrow = docs.select(*columns)
    hits_as = free_name(docs, "_hits")
    hit_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
    at = columns.index(text)
    blocks = blocks_of(benchmark, item, item_text, size, block_windows)
    block: list | None = next(blocks)
    current = narrow
    final = StructType([*narrow.schema.fields, StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", SPANS)])
    while block is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        @tidy
        def passes(batches: Iterator[pa.RecordBatch], shared=shared, tag=uuid.uuid4().hex, last=following is None) -> Iterator[pa.RecordBatch]:
            if tag not in _scanners:
                _scanners.clear()
                _scanners[tag] = Scanner(shared.value, size)
            scanner = _scanners[tag]
            for batch in batches:
                before = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else None
                rows: list = []
                for lo, raw, offsets in groups(batch.column(at)):
                    low, start, stop = words_in(raw, offsets)
                    text_no = np.searchsorted(offsets, start, side="right") - 1
                    found = scanner.scan(text_no, low, start, stop)
                    first = np.searchsorted(text_no, np.arange(len(offsets)))
                    for t in range(len(offsets) - 1):
                        hits = [(h["first"], h["last"], h["item"]) for h in before[lo + t]] if before else []
                        x, y = int(first[t]), int(first[t + 1])
                        hits += [(a - x, b - x, "" if i is None else str(i)) for a, b, i in found.get(t, ())]
                        if last:
                            rows.append(summary(raw[offsets[t] :], start[x:y] - offsets[t], stop[x:y] - offsets[t], hits))
                        else:
                            rows.append([dict(zip(("first", "last", "item"), h, strict=True)) for h in hits])
                own = list(batch.columns[: len(columns)])
                if last:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [*columns, *new])
                else:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(rows, hit_type)], [*columns, hits_as])

        if following is None:
            current = current.mapInArrow(passes, final)
        else:
            done, current = current, cut_table(current.mapInArrow(passes, StructType([*narrow.schema.fields, StructField(hits_as, ArrayType(HIT))])))
            discard(done)
        block = following
    return current


def summary(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, hits: list[tuple[int, int, str]]) -> tuple[int, int, list[str], list[dict]]:
    """n_words, n_hit, items and spans of the text that begins at ``raw``, with the places of its words."""
    if not hits:
        return len(start), 0, [], []
    runs: list[list[int]] = []
    for a, b, _ in sorted(hits, key=lambda h: h[:2]):
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    spans, known, chars = [], 0, 0
    for a, b in runs:
        ends = []
        for byte in (int(start[a]), int(stop[b])):
            chars += int(((raw[known:byte] & 0xC0) != 0x80).sum())
            known = byte
            ends.append(chars)
        spans.append({"start": ends[0], "end": ends[1]})
    return len(start), sum(b - a + 1 for a, b in runs), sorted({i for *_, i in hits}), spans


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
