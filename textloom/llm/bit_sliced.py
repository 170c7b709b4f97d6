"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers. The index keeps, for blocks of vectors, one bitmap for each bit of
each component. A query adds up the slices of all components, times its own values, with bitmap
arithmetic into the slices of a sum; the best rows are then selected from the sum's most significant
slice downward, and rows that tie at the boundary are told apart by their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, cut_table, give_back, ordinal_within
from textloom.operators.ordering import small

#: Vectors in a block of the index, and vectors in a row whose queries meet a block together; both bound a task's memory.
BLOCK, SPAN = 1 << 15, 12_800
SCALE = 256.0
TOP = 5


def quantised(vector: Column | str, scale: float = SCALE) -> Column:
    """Each component times ``scale``, rounded down; null for vectors that are null or have a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~odd, F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of bits of each column, and the bitmaps of what is above the least, column by column from the lowest bit."""
    low = values.min(axis=0)
    n_bits = np.array([(int(m) - int(x)).bit_length() for m, x in zip(values.max(axis=0), low, strict=True)], np.int32)
    above = values.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, which is right for any two 64-bit values
    maps = np.zeros((int(n_bits.sum()), -(-len(values) // 64) * 8), np.uint8)
    at = 0
    for column, n in enumerate(n_bits):
        for b in range(n):
            packed = np.packbits((above[:, column] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            maps[at, : len(packed)] = packed
            at += 1
    return low, n_bits, maps.view("<u8")


def added(stack: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sum, without carries, of bitmaps of one weight, and the carries into the next: full adders on thirds until one is left."""
    carries = []
    while len(stack) > 1:
        m = len(stack) // 3
        if m:
            a, b, c, rest = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m], stack[3 * m :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            stack = np.concatenate([half ^ c, rest])
        else:
            carries.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
    return stack[0], carries


class Block:
    """The index of one block: what is added up for a query, and the selection from the sum."""

    def __init__(self, n: int, low: np.ndarray, n_bits: np.ndarray, maps: bytes) -> None:
        self.n, self.low = n, [int(x) for x in low]
        words = -(-n // 64)
        self.maps = np.frombuffer(maps, "<u8").reshape(-1, words)
        self.column = np.repeat(np.arange(len(n_bits)), n_bits)
        self.bit = np.concatenate([np.arange(b) for b in n_bits] or [np.zeros(0, int)]).astype(int)
        self.most = [(1 << int(b)) - 1 for b in n_bits]
        self.valid = np.frombuffer(np.packbits(np.arange(words * 64) < n, bitorder="little").tobytes(), "<u8")

    def sums(self, query: list[int]) -> tuple[np.ndarray, int]:
        """Slices of a sum, lowest first, and the constant that makes it the inner product.

        A negative value counts what a component is below its greatest, so that nothing is subtracted.
        """
        by_weight: dict[int, list[np.ndarray]] = {}
        size = np.array([abs(x) for x in query], object if max(map(abs, query), default=0) >> 62 else np.int64)
        below = np.where(np.array([x < 0 for x in query], bool), ~np.uint64(0), np.uint64(0))
        for t in range(max((abs(x).bit_length() for x in query), default=0)):
            use = np.flatnonzero(((size[self.column] >> t) & 1).astype(bool))
            weights = self.bit[use] + t
            for w in np.unique(weights):
                own = use[weights == w]
                by_weight.setdefault(int(w), []).append(self.maps[own] ^ below[self.column[own]][:, None])
        constant = sum(x * (low + (m if x < 0 else 0)) for x, low, m in zip(query, self.low, self.most, strict=True))
        out, w = [], 0
        while by_weight:
            if stacks := by_weight.pop(w, None):
                total, carries = added(np.concatenate(stacks))
                if carries:
                    by_weight.setdefault(w + 1, []).extend(carries)
            else:
                total = np.zeros_like(self.valid)
            out.append(total)
            w += 1
        return np.array(out).reshape(len(out), len(self.valid)), constant

    def top(self, query: list[int], k: int, without: int = -1) -> list[tuple[int, int]]:
        """(place in the block, score) of the ``k`` best, earlier places first among equals; ``without`` is left out."""
        slices, constant = self.sums(query)
        tied, sure, need = self.valid.copy(), np.zeros_like(self.valid), k
        if without >= 0:
            tied[without >> 6] &= ~(np.uint64(1) << np.uint64(without & 63))
        for s in slices[::-1]:
            higher = tied & s
            n = int(np.bitwise_count(higher).sum())
            if n >= need:
                tied = higher
            else:
                sure |= higher
                tied &= ~s
                need -= n
        places = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        chosen = [*places(sure), *places(tied)[:need]]
        score = lambda r: constant + sum((int(s[r >> 6]) >> (r & 63) & 1) << i for i, s in enumerate(slices))
        return [(int(r), score(int(r))) for r in chosen]


def _indexed(table: pa.Table) -> pa.Table:
    """The index of one block's rows (dims, block, ordinal, id, values)."""
    table = table.sort_by("ordinal").combine_chunks()
    dims, block = table["dims"][0].as_py(), table["block"][0].as_py()
    flat = table["values"].combine_chunks().flatten().to_numpy()
    low, n_bits, maps = sliced(flat.reshape(len(table), dims))
    ids = table["id"].combine_chunks()
    one = lambda xs, kind: pa.array([xs], kind)
    offsets = pa.array([0, len(table)], pa.int32())
    data = [one(dims, pa.int32()), one(block, pa.int64()), one(len(table), pa.int32()), pa.ListArray.from_arrays(offsets, ids), one(low.tolist(), pa.list_(pa.int64())), one(n_bits.tolist(), pa.list_(pa.int32())), one(maps.tobytes(), pa.binary())]
    give_back()
    return pa.table(data, ["dims", "block", "n", "ids", "low", "bits", "maps"])


def numbered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dims, id, values, ordinal): the vectors that take part, quantised and in the order of their keys, nulls last, for each number of components."""
    rows = vectors.select(F.col(key).alias("id"), quantised(vector).alias("values")).filter("values IS NOT NULL").withColumn("dims", F.size("values"))
    return ordinal_within(rows, "dims", [F.col("id").asc_nulls_last(), F.col("values")], ["id", "values"])


def build_index(ordered: DataFrame) -> DataFrame:
    """(dims, block, n, ids, low, bits, maps) from ``numbered``: a row for each block of ``BLOCK`` vectors, as a table in the shared folder."""
    blocked = ordered.withColumn("block", F.expr(f"(ordinal - 1) div {BLOCK}"))
    kind = ordered.schema["id"].dataType.simpleString()
    schema = f"dims int, block bigint, n int, ids array<{kind}>, low array<bigint>, bits array<int>, maps binary"
    return cut_table(blocked.groupBy("dims", "block").applyInArrow(_indexed, schema))


def _searched(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(queries):
            r = {c: index[c][0].as_py() for c in ("block", "n", "low", "bits", "maps")}
            first, block = r["block"] * BLOCK, Block(r["n"], r["low"], r["bits"], r["maps"])
            ids, dims = index["ids"].combine_chunks().flatten(), index["dims"][0].as_py()
            for at, query, values in zip(*(queries[c].to_pylist() for c in ("ordinal", "id", "values")), strict=True):
                own = at - 1 - first
                for place, score in block.top(values, k, own if 0 <= own < r["n"] else -1):
                    if not -(1 << 63) <= score < 1 << 63:
                        raise ValueError("a score beyond 64 bits")
                    out.append((dims, at, query, ids[place].as_py(), first + place, score))
        kinds = [pa.int32(), pa.int64(), queries.schema.field("id").type, queries.schema.field("id").type, pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["dims", "at", "query_id", "id", "place", "score"])

    return run


def top_products(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): for each vector whose key (column ``id``) fulfils ``queries``, the ``top`` others of greatest inner product.

    Equal scores are in the order of the keys, nulls last. Vectors that are null or have a null or
    non-finite component take no part; others meet those with as many components, and only the
    query's own row is left out, so rows that repeat it are found. Empty vectors score 0. A score
    beyond 64 bits is an error. Other columns don't matter, and an empty table gives no row.

    Blocks of vectors and of queries meet one by one, so each task holds one of either.
    """
    ordered = numbered(vectors, key, vector)
    index = build_index(ordered)
    sizes = cut(index.groupBy(F.col("dims").alias("of_dims")).agg(F.sum("n").alias("total")))
    sizes = small(sizes, sizes.count())
    upto = lambda step: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {step}")))
    sized = lambda df: df.join(sizes, F.col("dims") == F.col("of_dims"))
    asked = sized(ordered.filter(queries)).select("dims", upto(BLOCK).alias("block"), F.expr(f"(ordinal - 1) div {SPAN}").alias("span"), "ordinal", "id", "values")
    blocks = sized(index).select("*", upto(SPAN).alias("span")).drop("of_dims", "total")
    kind = ordered.schema["id"].dataType.simpleString()
    pair = ["dims", "block", "span"]
    met = blocks.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(_searched(top), f"dims int, at bigint, query_id {kind}, id {kind}, place bigint, score bigint")
    best = Window.partitionBy("dims", "at").orderBy(F.col("score").desc(), F.col("place"))
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "id", "score")
