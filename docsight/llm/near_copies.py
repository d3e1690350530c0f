"""Near copies by exact Jaccard similarity of word shingles.

SimHash fingerprints of the shingles, linked by the operator of
``simhash`` at ``APART`` differing bits or fewer, and bands of MinHash
values, for the copies that lie further apart, only propose: texts that
either links, through others too, form one family.  Inside a family every pair of different
classes is compared exactly.  A family too large for a task is cut into
tiles, each with the family's smallest member; then only members that are
not in that member's class meet all tiles.  No group is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, utf8
from .components import connected_components, merge_labels

SEED = 42
#: Similarity at which texts are copies, as a fraction of whole numbers.
LEAST = (4, 5)
#: Bands and values in each: a pair of similarity s shares none with probability (1 - s ** DEPTH) ** BANDS, 1.2e-8 at 0.8.
BANDS, DEPTH = 60, 6
#: Differing bits of linked fingerprints.
APART = 4
#: Shingles of a family that one tile holds, about.
TILE_SHINGLES = 1 << 17

_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 31, (BANDS * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, (BANDS * DEPTH, 1), dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingled(data: bytes | None, width: int = 5) -> np.ndarray:
    """The hashes of the lower-cased words' shingles, repeats included; a text of fewer words is one shingle."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[min(width, len(words)) - 1 :])], dtype=np.uint64)


def shingles(data: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted, distinct hashes of ``shingled``."""
    return np.unique(shingled(data, width))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a text's ``shingled`` hashes; 0 without words."""
    step = 1 << 16
    counts = (simhash.bit_counts(hashes[at : at + step]) for at in range(0, len(hashes), step))
    return simhash.majority(sum(counts, np.zeros(simhash.BITS, dtype=np.int64)), len(hashes))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * DEPTH, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(high), 512):
        np.minimum(least, (high[at : at + 512] * _TIMES + _PLUS).min(axis=1), out=least)
    values = least.reshape(BANDS, DEPTH).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(DEPTH):
        out = (out ^ values[:, k]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def joined(sets: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Labels of the classes that the pairs of an asked set and any other make at similarity LEAST or more."""
    labels = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), dtype=np.int8)
    p, q = LEAST
    for i in asked:
        apart = labels != labels[i]
        if not apart.any():
            continue
        own = at[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[at], starts, dtype=np.int64)
        mark[own] = 0
        j = np.flatnonzero(apart & ((p + q) * shared >= p * (sizes[i] + sizes)))
        merge_labels(labels, np.full(len(j), i), j)
    return labels


def signed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, ``key`` (equal for equal sets of shingles), ``print`` (the fingerprint) and ``bands``."""
    narrow = docs.select(*keep, utf8("text").alias("__text"))
    fields = narrow.schema.fields[:-1]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, made = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                every = shingled(text)
                prints.append(fingerprint(every))
                own = np.unique(every)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                made.append(bands(own))
            columns = [pa.array(keys, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*names, "key", "print", "bands"])

    return narrow.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", key binary, print long, bands array<long>")


def _print_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets (id, prints) whose fingerprints differ in ``APART`` bits at most."""
    dealt = sets.select("id", F.explode("prints").alias("print"))
    first = cut(dealt.groupBy("print").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")))
    equal = dealt.join(first.filter("n > 1").select("print", "b"), "print").filter("id <> b").select(F.col("id").alias("a"), "b")
    near = simhash.near_links(first.select("print"), APART)
    ends = [first.select(F.col("print").alias(c), F.col("b").alias(f"of_{c}")) for c in "ab"]
    return equal.unionByName(near.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b"))


def _band_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets (id, bands) that share a band."""
    dealt = sets.select("id", F.explode("bands").alias("band"))
    first = cut(dealt.groupBy("band").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "b"))
    return dealt.join(first, "band").filter("id <> b").select(F.col("id").alias("a"), "b")


def _families(sets: DataFrame) -> DataFrame:
    """(node, component) of the sets (id, prints, bands) that fingerprints or bands link with another, through others too."""
    return connected_components(_print_links(sets).unionByName(_band_links(sets)).distinct())


def _members(texts: DataFrame) -> DataFrame:
    """(family, id, n, held) of texts (family, id, text): n shingles, held as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["family", "id", "n", "held"]
            )

    return texts.select("family", "id", utf8("text").alias("text")).mapInArrow(run, "family long, id long, n long, held binary")


def _compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (family, t1, t2, asks, id, held): those that ask are compared with all of their family's tile."""
    keys = ["family", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            ids = np.array([r[1] for r in held], dtype=np.int64)
            labels = joined([np.frombuffer(r[2], dtype=np.uint64) for r in held], np.flatnonzero([r[0] for r in held]))
            at = np.flatnonzero(labels != np.arange(len(labels)))
            return ids[at], ids[labels[at]]

        def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            family, t1, t2, asks, ids, sets = (c.to_pylist() for c in batch.columns)
            out = []
            for key, row in zip(zip(family, t1, t2), zip(asks, ids, sets)):
                if key != now:
                    if len(held) > 1:
                        out.append(links(held))
                    now, held = key, []
                held.append(row)
            if out:
                yield batch_of(*(np.concatenate(x) for x in zip(*out)))
        if len(held) > 1:
            yield batch_of(*links(held))

    return rows.select(*keys, "asks", "id", "held").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "a long, b long")


def links(members: DataFrame, tile: int = TILE_SHINGLES) -> DataFrame:
    """Links (a, b) with the components of all pairs of a family at similarity LEAST or more.

    ``members`` (family, id, n, held) must be materialised; a family is named by its smallest id.
    """
    large = cut(members.groupBy("family").agg(F.sum("n").alias("n")).filter(F.col("n") > tile).select("family", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    dealt = members.join(F.broadcast(large), "family", "left").withColumn("t1", F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")))
    # the smallest member is in each tile once
    guests = dealt.filter("tiles is not null and id = family").withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = dealt.filter("tiles is null or id <> family")
    first = cut(_compared(own.unionByName(guests).withColumn("t2", F.lit(0)).withColumn("asks", F.lit(True))))
    if large.isEmpty():
        return first
    split = dealt.filter("tiles is not null")
    classes = connected_components(first).withColumnRenamed("node", "id")
    rest = cut(split.select("family", "id", "n").join(classes, "id", "left").filter(F.coalesce("component", "id") != F.col("family")).select("family", "id", "n"))
    if rest.isEmpty():
        return first
    deals = rest.groupBy("family").agg(F.ceil(F.sum("n") / tile).cast("int").alias("asked"))
    both = split.join(F.broadcast(deals), "family")
    all_ = both.withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("asked") - 1))).withColumn("asks", F.lit(False))
    ask = both.join(rest.select("id"), "id", "left_semi").withColumn("t2", F.pmod(F.xxhash64("id", F.lit(1)), F.col("asked")).cast("int"))
    ask = ask.withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("asks", F.lit(True))
    return first.unionByName(cut(_compared(all_.select(ask.columns).unionByName(ask))))


def firsts(docs: DataFrame, key: str, row: str, tile: int = TILE_SHINGLES) -> DataFrame:
    """(row): of each class of near copies the row of the smallest ``key``, null last, then the smallest ``row``."""
    first = F.min(F.struct(F.col(key).isNull().alias("none"), key, row)).alias("first")
    sets = cut(signed(docs, key, row).groupBy("key").agg(first, F.collect_set("print").alias("prints"), F.any_value("bands").alias("bands")).select(F.col(f"first.{row}").alias("id"), "first", "prints", "bands"))
    family = cut(_families(sets).select(F.col("component").alias("family"), F.col("node").alias(row)))
    texts = docs.select(row, "text").join(family, row).withColumnRenamed(row, "id")
    heads = connected_components(links(cut(_members(texts)), tile)).withColumnRenamed("node", "id")
    of_class = sets.select("id", "first").join(heads, "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("first").alias("first"))
    return of_class.select(F.col(f"first.{row}").alias(row))
