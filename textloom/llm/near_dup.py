"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies, over all documents, with one for each large group of copies: what a group
   shares is frequent because of the group and says nothing about other texts. Such groups are the
   buckets of plain min-hash bands with at least half a share ``theta`` of all documents, of which
   there are at most 2 * PLAIN_BANDS / theta. A shingle is frequent if at least a share ``theta``
   of what is counted has it. Blocks of documents report shingles that half that share of the block
   has; every frequent one is among those whose reports can still add up to it, whose number is
   bounded by 2 / theta times the mean number of shingles of a document. A second pass counts these
   exactly. idf is ln(n / df) in units of ln(1 / theta); all rarer shingles have 1.
2. Sampling. A shingle's weight is (1 + ln tf) * idf. Each lane of consistent weighted sampling
   draws one shingle of a text, and two texts draw alike with their weighted Jaccard similarity as
   probability. A lane's random numbers are quantiles picked by a hash of shingle and lane.
3. Banding. Texts that agree in all lanes of a band share a bucket. Equal texts are one node.
4. Links. Each node is verified against its buckets' first nodes by the weighted Jaccard
   similarity of the texts; links give components. In buckets with several components left, the
   nodes outside the bucket's largest are compared with all nodes of the others, in blocks, through
   an index of their shingles; buckets with the same members are compared once. So no pair in a
   shared bucket is left out unless it is in one component already, and a group of copies costs
   one link a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from textloom.llm.common import cut, cut_table, discard, hub_bound, hub_join, sheltered, tidy, unsheltered
from textloom.llm.shingles import groups, mix, shingle_counts

THRESHOLD = 0.8
BANDS, ROWS = 20, 4
LANES = BANDS * ROWS
#: Shingles in at least this share of documents weigh less than the others; the share is larger
#: where documents are so long that more than ``MOST_FREQUENT`` shingles could have it.
THETA, MOST_FREQUENT = 1e-3, 2_000_000
#: Plain min-hash bands by which large groups of copies are known, from one permutation in bins.
PLAIN_BANDS, PLAIN_ROWS = 8, 4
#: A text is a copy of a group's leader if at least this share of their min-hash values agrees.
PLAIN_ALIKE = 0.6
#: A block ends at so many documents or shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 8000, 4_000_000
#: Texts on each side of a block that is compared.
COMPARED = 500
#: Bytes of text that are verified side by side.
VERIFIED_BYTES = 4 << 20


class Weights:
    """idf of the frequent shingles; 1 for all others."""

    def __init__(self, ids: np.ndarray, df: np.ndarray, n_docs: int, theta: float = THETA) -> None:
        order = np.argsort(ids)
        self.ids = ids[order]
        span = np.log(max(n_docs / least_df(n_docs, theta), 1 + 1e-9))
        self.idf = np.clip(np.log(np.maximum(n_docs / np.maximum(df[order], 1), 1.0)) / span, 0.0, 1.0)

    def of(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weights of shingles; a thousandth at least, so a text of shingles that all have isn't empty."""
        weight = 1.0 + np.log(tf)
        if len(self.ids) and len(ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            weight = np.where(self.ids[at] == ids, np.maximum(weight * self.idf[at], 1e-3), weight)
        return weight


def least_df(n_docs: int, theta: float) -> float:
    return max(2.0, theta * n_docs)


class Lanes:
    """The lanes' random numbers: r and c from Gamma(2, 1) and b uniform, from a hash of shingle and lane."""

    def __init__(self, seed: int = 42) -> None:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros_like(u), np.full_like(u, 40.0)
        for _ in range(60):  # the quantiles, by halving
            x = (low + high) / 2
            below = 1 - (1 + x) * np.exp(-x) < u
            low, high = np.where(below, x, low), np.where(below, high, x)
        self.r, self.log_c = low.astype(np.float32), np.log(low).astype(np.float32)
        self.seeds = np.random.Generator(np.random.PCG64(seed)).integers(1 << 63, size=(LANES, 2), dtype=np.uint64) | np.uint64(1)

    def values(self, mixed: np.ndarray, other: np.ndarray, log_weight: np.ndarray, lane: int) -> np.ndarray:
        """ln a of each shingle, by its mixed id; the least of a text's is its sample. Equal values are equal draws (shingle and t).

        ``other`` says which shingles have a weight that isn't 1, and ``log_weight`` theirs.
        """
        h = (mixed ^ self.seeds[lane, 0]) * self.seeds[lane, 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        parts, halves = h.view(np.uint16), h.view(np.uint32)
        r = self.r.take(parts[2::4])
        b = halves[::2] * np.float32(2.0**-32)
        out = self.log_c.take(parts[3::4])
        out -= r * (np.float32(1) - b.astype(np.float32))
        if len(other):
            out[other] -= r[other] * np.floor(log_weight / r[other] + b[other].astype(np.float32))
        return out

    def samples(self, first: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sampled values of texts whose shingles begin at ``first``: a row for each text."""
        out = np.empty((len(first), LANES), np.float32)
        mixed = mix(ids.astype(np.uint64))
        other = np.flatnonzero(weight != 1.0)
        log_weight = np.log(weight[other]).astype(np.float32)
        for lane in range(LANES):
            out[:, lane] = np.minimum.reduceat(self.values(mixed, other, log_weight, lane), first)
        return out


_lanes: list[Lanes] = []


def lanes() -> Lanes:
    if not _lanes:
        _lanes.append(Lanes())
    return _lanes[0]


#: From which bin each bin borrows at each step: a random order for each bin.
_BORROWED = np.stack([np.random.Generator(np.random.PCG64(b)).permutation([x for x in range(PLAIN_BANDS * PLAIN_ROWS) if x != b]) for b in range(PLAIN_BANDS * PLAIN_ROWS)], axis=1)
_BORROWED = np.concatenate([np.arange(PLAIN_BANDS * PLAIN_ROWS)[None], _BORROWED])


def plain_sketch(of: np.ndarray, ids: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Min-hash values of each text's set of shingles with one permutation, and hashes of their bands; 0 for texts without words.

    A shingle's last bits say its bin and the others its rank there; empty bins take the value of
    the first filled one in an order of their own.
    """
    bins = PLAIN_BANDS * PLAIN_ROWS
    place = (of * bins + ids % bins).astype(np.uint64) << np.uint64(43) | (ids // bins).astype(np.uint64)
    place.sort()
    cell = (place >> np.uint64(43)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    least = np.zeros(n_texts * bins, np.uint64)
    least[cell[new]] = mix(place[new] & np.uint64((1 << 43) - 1)) | np.uint64(1)
    least = least.reshape(n_texts, bins)
    full = least.copy()
    for step in range(1, bins):
        empty = full == 0
        if not empty.any():
            break
        moved = least[:, _BORROWED[step]]
        full = np.where(empty & (moved != 0), mix(moved + np.uint64(step)) | np.uint64(1), full)
    h = np.full((n_texts, PLAIN_BANDS), np.arange(1, PLAIN_BANDS + 1), np.uint64)
    for k in range(PLAIN_ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + full[:, k::PLAIN_ROWS])
    return full.view(np.int64), np.where((full != 0).any(axis=1)[:, None], h, np.uint64(0)).view(np.int64)


def digest_of(text: str) -> Column:
    """What makes texts equal; null is the empty text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


SIGNED = ArrayType(LongType())


def name_of(key: str) -> Column:
    return F.col(key).cast("string")


class Copies:
    """The large groups of copies: by bucket, the document of each that counts and its sketch."""

    def __init__(self, rows: list[tuple[int, str | None, str, list[int]]]) -> None:
        self.buckets = np.array(sorted(r[0] for r in rows), np.int64)
        self.leaders = {h: (name, digest) for h, name, digest, _ in rows}
        self.sketches = {h: np.array(sketch, np.int64) for h, *_, sketch in rows}

    def counted(self, names: pa.Array, digests: pa.Array, sketch: np.ndarray, bands: np.ndarray, lo: int, seen: set) -> np.ndarray:
        """Which texts count: those that are not like the leader of a bucket; ``seen`` has the leaders that a task has counted."""
        out = np.ones(len(bands), bool)
        if not len(self.buckets):
            return out
        at = np.minimum(np.searchsorted(self.buckets, bands), len(self.buckets) - 1)
        hot = self.buckets[at] == bands
        for k in np.flatnonzero(hot.any(axis=1)).tolist():
            own = names[lo + k].as_py(), digests[lo + k].as_py()
            met = bands[k][hot[k]].tolist()
            others = [h for h in met if self.leaders[h] != own]
            if any((self.sketches[h] == sketch[k]).mean() >= PLAIN_ALIKE for h in others):
                out[k] = False
            elif len(others) < len(met):
                out[k] = own not in seen
                seen.add(own)
        return out


def large_groups(docs: DataFrame, key: str, text: str) -> tuple[Copies, int, int, float]:
    """The groups of copies, about how many documents count, the sum of all documents' distinct shingles, and theta."""
    schema = StructType([StructField("name", StringType()), StructField("digest", StringType()), StructField("n", LongType()), StructField("sketch", SIGNED), StructField("bands", SIGNED)])

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            values, bands, n = np.zeros((m, PLAIN_BANDS * PLAIN_ROWS), np.int64), np.zeros((m, PLAIN_BANDS), np.int64), np.zeros(m, np.int64)
            for lo, raw, offsets in groups(batch.column(2)):
                of, ids, _ = shingle_counts(raw, offsets)
                hi = lo + len(offsets) - 1
                values[lo:hi], bands[lo:hi] = plain_sketch(of, ids, hi - lo)
                n[lo:hi] = np.bincount(of, minlength=hi - lo)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (values, bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *lists], schema.names)

    sketched = cut_table(docs.select(name_of(key).alias("name"), digest_of(text).alias("digest"), text).mapInArrow(sketch, schema))
    n_docs, size = sketched.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    theta = max(THETA, 2 * size / max(n_docs, 1) / MOST_FREQUENT)
    buckets = sketched.select("name", "digest", F.explode("bands").alias("bucket")).filter("bucket <> 0")
    hot = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.lit(least_df(n_docs, theta / 2)))
    hot = cut(hot.select("bucket"))  # at most 2 * PLAIN_BANDS / theta
    inside = sketched.select("name", "digest", "sketch", F.explode("bands").alias("bucket")).join(F.broadcast(hot), "bucket")
    first = F.min(F.struct(F.col("name").isNull().alias("null"), "name", "digest", "sketch"))
    found = [tuple(r) for r in inside.groupBy("bucket").agg(first.alias("first")).select("bucket", "first.name", "first.digest", "first.sketch").collect()]
    n_inside = inside.select("name", "digest").distinct().count() if found else 0
    discard(sketched)
    return Copies(found), n_docs - n_inside, size, theta


def frequent_shingles(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Ids and document frequencies of all frequent shingles, how many documents counted, and theta.

    The result is bounded by ``MOST_FREQUENT`` in any case, and usually a few thousand.
    """
    copies, n_single, size, theta = large_groups(docs, key, text)
    pairs = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("docs", LongType())])
    names = ["id", "n", "docs"]
    groups_of_copies = docs.sparkSession.sparkContext.broadcast(copies)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        """Distinct shingles of each of the texts that count, group by group, and how many texts these are."""
        known, seen = groups_of_copies.value, set()
        for batch in batches:
            for lo, raw, offsets in groups(batch.column(2)):
                of, ids, _ = shingle_counts(raw, offsets)
                n = len(offsets) - 1
                if len(known.buckets):
                    kept = known.counted(batch.column(0), batch.column(1), *plain_sketch(of, ids, n), lo, seen)
                    ids, n = ids[kept[of]], int(kept.sum())
                yield ids, n

    def block(ids: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        found, count = np.unique(every, return_counts=True)
        kept = count >= theta / 2 * n
        found, count = found[kept], count[kept]
        for lo in range(0, len(found), 100_000):
            part = found[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[lo : lo + 100_000]), pa.array(np.full(len(part), n))], names)

    @tidy
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A full block waits for the next one, so that a task's last few documents join it.
        full: tuple[list[np.ndarray], int] = ([], 0)
        ids: list[np.ndarray] = []
        every = n = size = 0
        for own, own_n in shingles(batches):
            ids.append(own)
            every, n, size = every + own_n, n + own_n, size + len(own)
            if n >= BLOCK_DOCS or size >= BLOCK_SHINGLES:
                if full[1]:
                    yield from block(*full)
                full, ids, n, size = (ids, n), [], 0, 0
        yield from block(full[0] + ids, full[1] + n)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([every]), pa.array([0])], names)

    # Many small tasks are put together, up to a block of documents or of shingles but not below the
    # cores there are; blocks that are too small report all their shingles, a block's at most.
    texts = docs.select(name_of(key).alias("name"), digest_of(text).alias("digest"), text)
    parallel = docs.sparkSession.sparkContext.defaultParallelism  # small tables too are read by all cores
    some = texts.coalesce(max(parallel, n_single // BLOCK_DOCS, size // BLOCK_SHINGLES))  # never more than there are
    reports = cut(some.mapInArrow(report, pairs).groupBy("id").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    # How many documents count; a leader may have been met in several tasks, if its row is repeated.
    n_counted = reports.filter("id = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = least_df(n_counted, theta)
    possible = reports.filter(F.col("id") >= 0).filter(F.col("n") + (F.lit(n_counted) - F.col("docs")) * F.lit(theta / 2) >= F.lit(least)).select("id")
    candidates = np.sort(possible.toPandas()["id"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for ids, _ in shingles(batches):
            at = np.searchsorted(known, ids)
            at = at[known[np.minimum(at, len(known) - 1)] == ids] if len(known) else at[:0]
            total += np.bincount(at, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[found]), pa.array(total[found]), pa.array(np.zeros(len(found), np.int64))], names)

    if not len(candidates):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_counted, theta
    exact = texts.mapInArrow(count, pairs).groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(least)).toPandas()
    return exact["id"].to_numpy(np.int64), exact["n"].to_numpy(np.int64), n_counted, theta


def signatures(docs: DataFrame, key: str, text: str, weights) -> DataFrame:
    """``id``, ``digest`` and ``bands`` (a hash for each band) of each document.

    Texts without words have no bands.
    """
    schema = StructType([StructField("id", docs.schema[key].dataType), StructField("digest", StringType()), StructField("bands", SIGNED)])

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = lanes(), weights.value
        for batch in batches:
            bands = np.zeros((batch.num_rows, BANDS), np.int64)
            some = np.zeros(batch.num_rows, bool)
            for lo, raw, offsets in groups(batch.column(2)):
                of, ids, tf = shingle_counts(raw, offsets)
                if not len(of):
                    continue
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                drawn = own.samples(first, ids, table.of(ids, tf)).view(np.uint32).astype(np.uint64)
                h = np.full((len(drawn), BANDS), np.arange(1, BANDS + 1), np.uint64)
                for k in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + drawn[:, k::ROWS])
                at = lo + of[first]
                bands[at] = h.view(np.int64)
                some[at] = True
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(bands[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema.names)

    return docs.select(F.col(key).alias("id"), digest_of(text).alias("digest"), text).mapInArrow(sign, schema)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' sorted shingle ids and weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def shingled(column: pa.Array, table: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle ids and weights of each text."""
    out = []
    for _, raw, offsets in groups(column):
        of, ids, tf = shingle_counts(raw, offsets)
        w = table.of(ids, tf)
        at = np.searchsorted(of, np.arange(len(offsets)))
        out += [(ids[x:y], w[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b, similarity) of digests whose texts are at least ``threshold`` alike.

    A hot b, which many have as their leader, is dealt over as many tasks as its pairs need, each
    with a copy of its text; by the bound of hot keys these are at most twice ``BROADCAST_ROWS``.
    """
    total = pairs.count()
    bound = hub_bound(total)
    parts = F.ceil(F.col("n") / bound).cast("int")
    hot = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= bound).select(F.col("b").alias("_hot"), parts.alias("_parts")))
    dealt = pairs.join(F.broadcast(hot), F.col("b") == F.col("_hot"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part"))
    one = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    two = texts.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left").select(F.col("digest").alias("b"), copies.alias("part"), F.col("text").alias("text_b"))
    joined = dealt.join(one, "a").join(two, ["b", "part"]).select("a", "b", "text_a", "text_b")
    schema = StructType([StructField("a", StringType()), StructField("b", StringType()), StructField("similarity", DoubleType())])

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for whole in batches:
            step = max(1, int(whole.num_rows * VERIFIED_BYTES / max(whole.nbytes, 1)))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                # Rows of one b follow each other; each of its texts is shingled once.
                b = batch.column(1).to_pylist()
                new = [k for k in range(len(b)) if not k or b[k] != b[k - 1]]
                place = np.cumsum([not k or b[k] != b[k - 1] for k in range(len(b))]) - 1
                left, right = shingled(batch.column(2), table), shingled(batch.column(3).take(pa.array(new, pa.int64())), table)
                like = np.array([weighted_jaccard(x, right[p]) for x, p in zip(left, place, strict=True)])
                kept = pa.array(like >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(like[like >= threshold])], schema.names)

    return joined.mapInArrow(verify, schema)


def are_stars(edges: DataFrame) -> bool:
    """Whether each node a has one b, and no b is an a as well."""
    once = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return once and edges.select("b").distinct().join(edges.select(F.col("a").alias("_a")), F.col("b") == F.col("_a"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b); the root is the least node of the component.

    Rounds of large-star and small-star over the links until they are stars; each round's links
    are cut from their lineage. Minima are formed before the shuffle, and hubs get theirs by broadcast.
    """
    edges = cut_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def to_least(rows: DataFrame, read: list[DataFrame]) -> DataFrame:
        """(a, b, m): each link with the least node linked to a, from a table added to ``read``."""
        least = cut_table(rows.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")))
        read.append(least)
        return hub_join(rows, least, "a", "u", "_n", least.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])

    while not are_stars(edges):
        read = [edges]
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut_table(to_least(both, read).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct())
        joined = to_least(large, read)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        edges = cut_table(small.filter("a <> b").distinct())
        discard(large, *read)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


PAIRS = StructType([StructField("a", StringType()), StructField("b", StringType())])


def across(members: DataFrame, roots: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b) between texts that share a bucket of ``members`` (bucket, digest) but no component yet.

    In each bucket with several components, the texts outside its largest one are held against
    all texts of other components; of buckets with the same members one is taken. Both sides come
    in blocks of bounded size; small buckets share a block. Within a pair of blocks an index of the
    shingles gives the exact similarity of all pairs that share any, and only links leave the task.
    """
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_component"))
    placed = cut_table(members.join(known, F.col("digest") == F.col("_node"), "left").select("bucket", "digest", F.coalesce("_component", "digest").alias("component")))
    mark = F.sum(F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("mark").alias("mark")).filter("parts > 1")
    mixed = mixed.groupBy("all", "mark").agg(F.min(F.struct("bucket", "main", "most")).alias("x")).select("all", "x.*")
    blocks = lambda n: F.ceil(n / COMPARED).cast("int")
    main = cut_table(mixed.select(F.col("bucket").alias("_of"), "main", blocks(F.col("all")).alias("m_blocks"), blocks(F.col("all") - F.col("most")).alias("q_blocks"), "all"))
    # Small buckets share bins of about a block's size; a large one has a bin of its own.
    loose, total = main.agg(F.coalesce(F.sum(F.when(F.col("m_blocks") == 1, F.col("all"))), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    shared = F.pmod(F.xxhash64("_of"), F.lit(max(1, loose // COMPARED))).cast("string")
    tagged = hub_join(placed, main, "bucket", "_of", "all", total)
    tagged = tagged.join(texts.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
    block = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = tagged.select(F.when(F.col("m_blocks") > 1, F.concat(F.lit("b"), F.col("_of").cast("string"))).otherwise(shared).alias("bin"), F.col("_of").cast("string").alias("gathering"), "component", "main", "digest", "text", "m_blocks", "q_blocks")
    one = sides.filter("component <> main").select("bin", block("q_blocks").alias("q"), every("m_blocks").alias("m"), "gathering", "component", "digest", "text")
    two = sides.select("bin", every("q_blocks").alias("q"), block("m_blocks").alias("m"), "gathering", "component", "digest", "text")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs: list[tuple[str, str]] = []
        if left.num_rows and right.num_rows:
            table = weights.value
            _, of_gathering = np.unique(np.array(left["gathering"].to_pylist() + right["gathering"].to_pylist()), return_inverse=True)
            _, of_component = np.unique(np.array(left["component"].to_pylist() + right["component"].to_pylist()), return_inverse=True)
            n = left.num_rows
            queries, others = (shingled(t["text"].combine_chunks(), table) for t in (left, right))
            ids, weight = (np.concatenate([o[k] for o in others]) for k in (0, 1))
            row = np.repeat(np.arange(len(others)), [len(o[0]) for o in others])
            order = np.argsort(ids, kind="stable")
            ids, weight, row = ids[order], weight[order], row[order]
            total = np.bincount(row, weight, minlength=len(others))
            names, query_names = right["digest"].to_pylist(), left["digest"].to_pylist()
            for k, (own, own_weight) in enumerate(queries):
                lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
                found = hi - lo
                at = np.repeat(lo - np.cumsum(found) + found, found) + np.arange(found.sum())
                least = np.bincount(row[at], np.minimum(weight[at], np.repeat(own_weight, found)), minlength=len(others))
                like = least / np.maximum(total + own_weight.sum() - least, 1e-12) >= threshold
                like &= (of_gathering[n:] == of_gathering[k]) & (of_component[n:] != of_component[k])
                pairs += [(query_names[k], names[j]) for j in np.flatnonzero(like).tolist()]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.string()), "b": pa.array([p[1] for p in pairs], pa.string())})

    two = two.toDF(*two.columns)  # attributes of its own
    return one.groupBy("bin", "q", "m").cogroup(two.groupBy("bin", "q", "m")).applyInArrow(compare, PAIRS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``digest``, ``class_id``, ``class_digest``, ``class_size`` and ``n_links`` of each document.

    A class holds all documents joined by links of at least ``threshold`` weighted Jaccard
    similarity, equal texts included; its id is the least document id in it, its digest that of
    this document's text, and its size the number of its documents. ``n_links`` is the number of
    other texts that the text was found alike to; links within a class need not all be found, but
    they connect it. Null texts are empty ones; texts without words are alike only if equal. A
    text of fewer than five words is one shingle. Repeated rows and ids are kept; null ids come
    after all others. Other columns don't matter, whatever their names.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids, df, n_counted, theta = frequent_shingles(docs, "key", "text")
    weights = docs.sparkSession.sparkContext.broadcast(Weights(ids, df, n_counted, theta))
    signed = cut_table(signatures(docs, "key", "text", weights))
    nodes = cut_table(signed.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n")))

    bucketed = nodes.select("digest", "id", F.posexplode("bands").alias("band", "hash")).select("digest", "id", F.xxhash64("band", "hash").alias("bucket"))
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "digest"))
    leaders = cut_table(bucketed.groupBy("bucket").agg(first["digest"].alias("leader"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("bucket", "_bucket"))
    total = leaders.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    members = cut_table(hub_join(bucketed, leaders, "bucket", "_bucket", "_n", total).select("bucket", "digest", "leader"))
    stars = cut_table(members.filter("digest <> leader").select(F.col("digest").alias("a"), F.col("leader").alias("b")).distinct())

    linked = members.select(F.col("digest").alias("_digest")).distinct()
    wanted = nodes.select("digest", "id").join(linked, F.col("digest") == F.col("_digest")).select(F.col("digest").alias("_digest"), F.col("id").alias("_id"))
    keyed = docs.select("key", digest_of("text").alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = keyed.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("key").eqNullSafe(F.col("_id")))
    texts = cut_table(found.dropDuplicates(["digest", "key"]).select("digest", "text"))

    links = cut_table(verified(stars, texts, weights, threshold).select("a", "b"))
    discard(stars, leaders)
    roots = cut_table(components(links))
    more = cut_table(across(members.select("bucket", "digest"), roots, texts, weights, threshold))
    discard(texts, members)
    if not more.isEmpty():
        links = cut_table(links.union(more))
        roots = cut_table(components(links))

    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    once = links.select(least, most).distinct()
    ends = once.select(F.col("a").alias("_end")).union(once.select(F.col("b").alias("_end"))).groupBy("_end").agg(F.count(F.lit(1)).alias("_links"))
    classed = nodes.select("digest", "id", "n").join(roots, F.col("digest") == F.col("node"), "left").join(ends, F.col("digest") == F.col("_end"), "left")
    classed = cut_table(classed.select("digest", "id", "n", F.coalesce("root", "digest").alias("root"), F.coalesce("_links", F.lit(0)).alias("n_links")))
    whole = cut_table(classed.groupBy("root").agg(first.alias("first"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("_texts")).withColumnRenamed("root", "_root"))
    placed = hub_join(classed, whole, "root", "_root", "_texts", whole.agg(F.coalesce(F.sum("_texts"), F.lit(0))).first()[0])
    classes = cut_table(placed.select(F.col("digest").alias("_digest"), F.col("first.id").alias("class_id"), F.col("first.digest").alias("class_digest"), "class_size", "n_links", "n"))
    discard(nodes, links, roots, classed, whole)
    out = hub_join(signed.select("id", "digest"), classes, "digest", "_digest", "n", classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return out.select("id", "digest", "class_id", "class_digest", "class_size", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class, the document with the least id.

    Of rows that repeat this document, one stays. All columns pass through, whatever their names.
    """
    classes = near_duplicates(docs, key, text, threshold)
    kept = classes.filter(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))).select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    marked = sheltered(docs, key=F.col(key), digest=digest_of(text))
    found = marked.join(kept, F.col("key").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    return found.dropDuplicates(["key", "digest"]).select(*unsheltered(docs.columns))
