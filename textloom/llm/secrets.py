"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near hits, checksums.

A text is scanned once by an automaton over all keywords. Only where a keyword occurs is the
anchored expression of its kind tried; runs of hexadecimal digits, which have no keyword, are
looked for at the places where four bytes at a stride of four are all such digits, as any run of
sixteen has. Tokens that carry a checksum count only if it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textloom.llm.common import tidy

# Kinds in their order, keywords, and expressions anchored at the keyword.
KINDS = ("assign", "access", "hex", "github", "npm", "card")
BASE = KINDS[:3]
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_[0-9A-Za-z]+")
NPM = re.compile(rb"npm_[0-9A-Za-z]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")), ("npm", ("npm_",))):
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()
    return automaton


def crc_holds(token: bytes) -> bool:
    """Whether the last 6 of a token's 36 characters are the CRC32 of the first 30 in base 62."""
    body = token.split(b"_", 1)[1]
    if len(body) != 36:
        return False
    value, digits = zlib.crc32(body[:30]), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits.encode() == body[30:]


def luhn_holds(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = (d - 48) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True


def hex_runs(text: bytes) -> list[tuple[int, int]]:
    """The longest runs of at least 16 of the characters 0-9a-f."""
    at = _HEX_BYTE[np.frombuffer(text, np.uint8)[::4]]
    if len(at) < 4:
        return []
    found: list[tuple[int, int]] = []
    done = 0
    for k in np.flatnonzero(at[:-3] & at[1:-2] & at[2:-1] & at[3:]).tolist():
        p = 4 * k
        if p < done:
            continue
        start = p
        while start > done and _HEX_BYTE[text[start - 1]]:
            start -= 1
        done = HEX.match(text, start).end()
        if done - start >= LEAST["hex"]:
            found.append((start, done))
    return found


def find_secrets(text: bytes, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each span, in bytes, by start and then by the order of the kinds."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    hits = [(end - n + 1, kind) for end, (kind, n) in automaton.iter(text.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < done[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}[kind].match(text, start)
        if not m:
            continue
        done[kind] = m.end()
        if kind == "assign":
            good = m.end(1) - m.start(1) >= LEAST["assign"]
        else:
            good = len(m[0]) >= LEAST["access"] if kind == "access" else crc_holds(m[0])
        if good:
            found.append((kind, start, m.end()))
    for start, end in hex_runs(text):
        found.append(("hex", start, end))
        if end - start <= 19 and text[start:end].isdigit() and luhn_holds(text[start:end]):
            found.append(("card", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(kind, int(before[a]), int(before[b])) for kind, a, b in spans]


def scan_secrets(docs: DataFrame, text: str = "text", spans_as: str = "secrets") -> DataFrame:
    """Adds ``spans_as``, the spans (kind, start, end) of secrets in each whole ``text``.

    Offsets are code points, ends exclusive; spans go by start and then kind. Null and empty texts
    have none. A column of that name is replaced; other columns, repeated rows and null keys pass
    through. Rows are independent, so nothing is shuffled and a lost task is simply run again.
    """
    columns = [c for c in docs.columns if c != spans_as]
    narrow = docs.select(*columns)
    at = columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for batch in batches:
            rows = []
            for value in batch.column(at).cast(pa.binary()):
                raw = value.as_py() or b""
                rows.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_code_points(raw, find_secrets(raw, automaton))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*columns, spans_as])

    return narrow.mapInArrow(scan, StructType([*narrow.schema.fields, StructField(spans_as, ArrayType(SPAN))]))
