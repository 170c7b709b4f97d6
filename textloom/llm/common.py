"""Helpers that several operators share; ordinals and lineage cuts are the library's own."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordering import BROADCAST_ROWS, cut, cut_table, discard, ordinal_within, shuffle_partitions, throwaway

__all__ = ["BROADCAST_ROWS", "cut", "cut_table", "discard", "free_name", "give_back", "hub_bound", "hub_join", "ordinal_within", "sheltered", "shuffle_partitions", "spread_join", "throwaway", "tidy", "unit_interval", "unsheltered"]


def tidy(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``f``, a function over Arrow batches, giving free memory back to the system when a task ends.

    Python workers live on between tasks, beside a JVM that needs the room.
    """

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def sheltered(df: DataFrame, without: tuple[str, ...] = (), **used: Column) -> DataFrame:
    """``row``, a struct of all columns but those ``without``, and the expressions in ``used``; so no name in ``df`` meets one used inside."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return df.select(F.struct(*(kept or [F.lit(0).alias("none")])).alias("row"), *[value.alias(name) for name, value in used.items()])


def unsheltered(columns: list[str], row: str = "row") -> list[Column]:
    """The named columns of the struct that ``sheltered`` made."""
    return [F.col(row)[c].alias(c) for c in columns]


def unit_interval(*parts: Column | str) -> Column:
    """A number in [0, 1) from an md5 over ``parts``; the same on every engine that has md5."""
    text = F.concat_ws("~", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def spread_join(rows: DataFrame, values: DataFrame, key: str, other: str, n: int, spread_by: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """A null-safe join of ``rows`` to ``values``, a table of ``n`` counted rows with one for each key.

    A small table is broadcast; else each of its rows is repeated for every salt, and the rows of a
    hot key are spread over the salts by a hash of ``spread_by``.
    """
    match = F.col(key).eqNullSafe(F.col(other))
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(values), match, how)
    salted = values.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = rows.withColumn("_salt_l", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return own.join(salted, match & (F.col("_salt_l") == F.col("_salt_r")), how).drop("_salt_l", "_salt_r")


#: Keys with fewer rows than this are never set apart.
HUB_ROWS = 64


def hub_join(rows: DataFrame, values: DataFrame, key: str, other: str, count: str, total: int) -> DataFrame:
    """An inner join of ``rows`` to ``values``, which has each key once and in ``count`` how many of the ``total`` rows have it.

    Keys with so many rows that at most ``BROADCAST_ROWS`` keys can have them are joined by
    broadcast, so the rows of a hot key stay where they are; the others are shuffled. Both sides
    are read twice and should be tables that were cut. ``count`` isn't returned.
    """
    bound = hub_bound(total)
    hot, rest = values.filter(F.col(count) >= bound).drop(count), values.filter(F.col(count) < bound).drop(count)
    own = rows.join(F.broadcast(hot), F.col(key) == F.col(other))
    return own.unionByName(rows.join(F.broadcast(hot.select(other)), F.col(key) == F.col(other), "left_anti").join(rest, F.col(key) == F.col(other)))


def hub_bound(total: int) -> int:
    """From so many rows a key is hot; at most ``BROADCAST_ROWS`` keys are."""
    return max(HUB_ROWS, -(-total // BROADCAST_ROWS))
