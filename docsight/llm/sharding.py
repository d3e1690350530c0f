"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in an order fixed by their key columns, whatever
the cluster's partitioning.  A keyed Feistel network permutes the numbers;
results outside 0..n-1 walk on along their cycle until they fall inside.
Position p goes to shard p mod k, slot p div k, so shard and slot of any
row number, and the row number of any slot, follow by arithmetic alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
#: Rows of equal keys are expanded in runs of this many.
RUN = 1 << 16


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _half_bits(n: int) -> np.uint64:
    return np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))


def _round_key(key: int, i: int) -> int:
    return key * 0x100000001B3 + (i + 1) * 0xD6E8FEB86659FD93


def _network(x: np.ndarray, n: int, key: int, backwards: bool) -> np.ndarray:
    bits = _half_bits(n)
    mask = np.uint64((1 << int(bits)) - 1)
    left, right = x >> bits, x & mask
    if backwards:
        for i in reversed(range(ROUNDS)):
            left, right = right ^ (_mix(left, _round_key(key, i)) & mask), left
    else:
        for i in range(ROUNDS):
            left, right = right, left ^ (_mix(right, _round_key(key, i)) & mask)
    return (left << bits) | right


def _walk(rows: np.ndarray, n: int, key: int, backwards: bool) -> np.ndarray:
    out = _network(np.asarray(rows, dtype=np.uint64), n, key, backwards)
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = _network(out[outside], n, key, backwards)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """Positions of row numbers, a permutation of 0..n-1."""
    return _walk(rows, n, key, False)


def unpermute(positions: np.ndarray, n: int, key: int) -> np.ndarray:
    """Row numbers of positions: the inverse of :func:`permute`."""
    return _walk(positions, n, key, True)


def row_at(shard: int, slot: int, n: int, shards: int, key: int) -> int:
    """The row number in a slot of a shard, without looking at any data."""
    return int(unpermute(np.array([slot * shards + shard]), n, key)[0])


def number_rows(df: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """One row per row of ``df``: ``columns``, ``row_number`` (0..n-1) and ``n_rows``.

    The order is (hash bucket of all columns, then the columns); it depends
    on the values only.  Equal rows are counted before the shuffle and
    expanded after it, so no bucket is swollen by repetition.  ``buckets``
    is part of the order: keep it fixed for a dataset.  The bucket offsets
    are at most ``buckets`` rows, which bounds what is broadcast.
    """
    bare = df.select(*columns)
    bucketed = bare.groupBy(*columns).agg(F.count(F.lit(1)).alias("__times")).withColumn(
        "__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
    )
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("__bucket")
        .agg(F.sum("__times").alias("__in_bucket"))
        .select(
            "__bucket",
            F.coalesce(F.sum("__in_bucket").over(before), F.lit(0)).alias("__offset"),
            F.sum("__in_bucket").over(Window.partitionBy()).alias("n_rows"),
        )
    )
    inside = (
        Window.partitionBy("__bucket")
        .orderBy(*[F.col(c).asc_nulls_first() for c in columns])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = (
        bucketed.withColumn("__first", F.coalesce(F.sum("__times").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("__start", F.col("__offset") + F.col("__first"))
    )
    runs = first.withColumn("__run", F.explode(F.expr(f"sequence(0L, (__times - 1) div {RUN})")))
    each = runs.withColumn(
        "__i", F.explode(F.expr(f"sequence(__run * {RUN}, least(__times, (__run + 1) * {RUN}) - 1)"))
    )
    return each.select(*columns, (F.col("__start") + F.col("__i")).alias("row_number"), "n_rows")


def assign_shards(df: DataFrame, columns: list[str], shards: int = 16, key: int = 2024) -> DataFrame:
    """Put every row of ``df`` into a shard and slot.

    ``columns`` identify a row; rows equal in all of them are interchangeable
    and each gets a slot of its own.  Null values are values like any other,
    texts play no part unless listed, an empty table gives an empty result,
    and further columns of ``df`` are ignored, whatever their names.
    Returns ``columns``, ``row_number``, ``n_rows``, ``shard`` and ``slot``.
    Shard sizes differ by one row at most.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("long")
    def position(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), int(n.iloc[0]), key) if len(row) else row)

    placed = number_rows(df, columns).withColumn("__at", position("row_number", "n_rows"))
    return placed.select(
        *columns,
        "row_number",
        "n_rows",
        F.pmod(F.col("__at"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__at div {shards}").cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, key: int = 2024) -> DataFrame:
    """Shards of ``documents`` under the law ``rows`` (counts at most one apart).

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 its unsigned
    CRC-32 (null text: null).  Rows equal in doc_id, size and checksum are
    interchangeable.  ``grown_shard`` belongs to another law and is null.
    """
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
    )
    return assign_shards(sized, ["doc_id", "size", "text_crc32"], shards, key).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
