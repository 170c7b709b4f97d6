"""WARC archives: a writer of one gzip member per record, and a reader that splits files anywhere.

Reader tasks get byte ranges. Each scans its range for the gzip magic, takes a candidate as a
member only if its first decoded bytes are a WARC version line and the whole member decodes with
its checksum, and owns the records whose members start inside the range; the last one may end
beyond it. After a member, the next is looked for where it ended.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from textloom.llm.common import cut, hub_bound, sheltered, shuffle_partitions, throwaway, unsheltered

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Record ids are this and the page's id as text, percent-encoded.
RECORD_ID = "urn:page"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20

FILES = StructType([StructField("path", StringType()), StructField("n_records", LongType()), StructField("n_bytes", LongType())])
RECORDS = StructType([StructField("page_id", StringType()), StructField("url", StringType()), StructField("record_type", StringType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("refers_to", StringType()), StructField("payload", BinaryType()), StructField("path", StringType()), StructField("offset", LongType())])


def record_id(page_id: object) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else ':' + urllib.parse.quote(str(page_id), safe='')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One gzip member: a response, or a revisit if ``refers_to`` is given, which has no payload but its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of a record."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def page_of(record_id: str | None) -> str | None:
    m = re.fullmatch(rf"<{RECORD_ID}:([^>]*)>", record_id or "")
    return urllib.parse.unquote(m[1]) if m else None


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """Adds ``digest`` (SHA-1, hexadecimal) and ``refers_to`` to each page.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest key is kept
    whole and the others refer to it; rows that share that key are all kept whole, and null keys
    come after all others. Null payloads are empty ones. Counts per digest are summed before the
    shuffle. The few digests that can have many pages are joined by broadcast, and their rows are
    spread by key in the join with the others. Columns named like the new ones are replaced.
    """
    digest = F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary"))
    columns = [c for c in pages.columns if c not in ("digest", "refers_to")]
    groups = pages.select(digest.alias("of"), F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("n")).filter(F.col("n") >= least)
    groups = cut(groups.groupBy("of").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    bound = hub_bound(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = groups.filter(F.col("n") >= bound).select(F.col("of").alias("hot"), F.col("first").alias("hot_first"))
    rest = groups.filter(F.col("n") < bound).select("of", "first")
    packed = sheltered(pages.select(*columns), key=F.col(key), digest=digest)
    joined = packed.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    probe = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("spread "), F.xxhash64("key").cast("string")))
    joined = joined.withColumn("probe", probe).join(rest, F.col("probe") == F.col("of"), "left").withColumn("found", F.coalesce("hot_first", "first"))
    refers = F.when(F.col("found").isNotNull() & ~F.col("key").eqNullSafe(F.col("found")), F.col("found"))
    return joined.select(*unsheltered(columns), "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each page below ``folder``; a table of the files with records and bytes.

    Tasks write files of about ``file_bytes`` under names of their own and move them to their
    places when they are whole. The table comes from the attempts that succeeded and is kept in
    the shared folder, so files of lost or repeated attempts are in no table. Keys of any type are
    written as text; null keys, urls and payloads are allowed, and repeated rows are records of
    their own. Other columns don't matter, whatever their names.
    """
    narrow = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = with_revisits(narrow, "key", "html", least).select(F.col("key").cast("string").alias("key"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
                done.append((f"{folder.rstrip('/')}/{name}", n, size))
                out = None

        for batch in batches:
            for page, address, text, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}.tmp")
                member = record(page.as_py(), address.as_py(), (text.as_py() or "").encode(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers.as_py())
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    return cut(rows.mapInArrow(write, FILES))


class Window:
    """Bytes of a file from a place that moves on, read block by block."""

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.base, self.data, self.pos = file, start, b"", 0
        file.seek(start)

    @property
    def at(self) -> int:
        return self.base + self.pos

    def more(self) -> int:
        """Reads a block behind the others, and lets go of what lies before the place; the bytes let go of, or -1 at the end."""
        block, gone = self.file.read(BLOCK), self.pos
        self.data, self.base, self.pos = self.data[gone:] + block, self.base + gone, 0
        return gone if block else -1


def member_at(window: Window) -> tuple[bytes, int] | None:
    """The decoded gzip member at the window's place and its length, if it is one and holds a record."""
    decoder = zlib.decompressobj(31)
    parts, size, fed = [], 0, window.pos
    start = window.at
    try:
        while not decoder.eof:
            if fed == len(window.data):
                gone = window.more()
                if gone < 0:
                    return None
                fed -= gone
            piece = window.data[fed : fed + (1 << 14)]
            part = decoder.decompress(piece)
            fed += len(piece)
            parts.append(part)
            if size < len(VERSION) <= size + len(part) and not b"".join(parts).startswith(b"WARC/1."):
                return None
            size += len(part)
    except zlib.error:
        return None
    return (b"".join(parts), window.base + fed - len(decoder.unused_data) - start) if size >= len(VERSION) else None


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in ``[start, end)``."""
    window = Window(file, start)
    while window.at < end:
        found = window.data.find(MAGIC, window.pos)
        if found < 0:
            window.pos = max(window.pos, len(window.data) - len(MAGIC) + 1)
            if window.more() < 0:
                return
            continue
        window.pos = found
        offset = window.at
        if offset >= end:
            return
        member = member_at(window)
        if member is None:
            window.pos += 1
            continue
        yield offset, member[0]
        window.pos += member[1]
        if window.pos > len(window.data):
            window.more()


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, key_type: str = "bigint") -> DataFrame:
    """The records of the archives in a table with ``path`` and ``n_bytes``, one row for each.

    Payloads are null in revisits, and in all rows without ``with_payload``; length and digest are
    those of the full payload: of a response they are computed from what was read, of a revisit
    taken from its headers. Records of other types are passed over. ``key_type`` is the type of the
    keys that were written; a key that isn't of that type is an error.
    """
    spark = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long")))
    ranges = files.filter("n_bytes > 0").select("path", starts.alias("start")).repartition(shuffle_partitions(spark), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], RECORDS.names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as file:
                    for offset, text in records_in(file, start, start + split_bytes):
                        fields, block = parse(text)
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        else:
                            n = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)[1])
                            digest = fields["warc-payload-digest"].partition(":")[2]
                        kept = payload if with_payload and kind == "response" else None
                        rows.append((page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, n, digest, page_of(fields.get("warc-refers-to")), kept, path, offset))
                        held += len(kept or b"")
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    found = ranges.mapInArrow(read, RECORDS)
    return found.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one, deleted when the driver's Python process ends."""
    return throwaway(spark, "warc")
