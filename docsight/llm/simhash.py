"""SimHash near-duplicates by a self-join of binary tries.

Of m blocks, fingerprints within k differing bits agree on m - k at least.
For each choice of m - k blocks the fingerprints are turned so that these
lead, and those that agree on them form the subtrees of one trie.  A subtree
is joined with itself: pairs of nodes go down together, differing bits add
up, and a pair is pruned once they exceed k.  The more fingerprints there
are, the more blocks are taken, so that subtrees stay small; those too large
for a task are split into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merge_labels

BITS = 64
SEED = 42
#: Fingerprints in a tile of a subtree.
TILE = 2048
#: Node pairs looked at together.
FRONT = 1 << 20
#: Fingerprints joined together; whole subtrees.
TASK_ROWS = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: a bit is set if over half of them have it."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """SimHash of the lower-cased words' shingles: a bit is set if over half of the hashes have it; 0 without words."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        upto = min(n, at + (1 << 16))
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:upto], ends[min(width, len(words)) - 1 + at :])]
        counts += bit_counts(np.array(hashes, dtype=np.uint64))
    return majority(counts, n)


def trie_pairs(codes: np.ndarray, shared: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted, distinct ``codes`` that agree on the first ``shared`` bits and differ in ``budget`` at most.

    A node is a range of the sorted codes.  Pairs of nodes are held in
    arrays and go down one level at a time; both may be the same node.
    """
    top = codes >> np.uint64(BITS - shared) if shared else np.zeros(len(codes), dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(codes))
    many = last - first > 1
    a, b = first[many].astype(np.int32), last[many].astype(np.int32)
    stack = [(shared, a, b, a, b, np.zeros(len(a), dtype=np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a, b, c, d, errors = stack.pop()
        if not len(a):
            continue
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(depth, *(x[s] for x in (a, b, c, d, errors))) for s in (slice(half), slice(half, None))]
            continue
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            yield i[near], j[near]
            a, b, c, d, errors = (x[~single] for x in (a, b, c, d, errors))
        if depth == BITS or not len(a):
            continue
        if depth not in ones:
            bit = (codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
        up = ones[depth]
        m, k = b - (up[b] - up[a]), d - (up[d] - up[c])
        same = a == c
        apart, other = errors + 1, ~same
        grown = [
            np.concatenate(x)
            for x in (
                (a, m, a, m[other]),
                (m, b, m, b[other]),
                (c, k, k, c[other]),
                (k, d, d, k[other]),
                (errors, errors, apart, apart[other]),
            )
        ]
        a, b, c, d, errors = grown
        live = (b > a) & (d > c) & (errors <= budget) & ~((a == c) & (b - a == 1))
        stack.append((depth + 1, *(x[live] for x in grown)))


Arm = list[tuple[int, int]]  # (offset, width) of a fingerprint's blocks, in a new order


def arms(budget: int, leading: int = 1) -> list[Arm]:
    """For each choice of ``leading`` of ``budget`` + ``leading`` blocks, the blocks in order, the chosen ones first."""
    n = budget + leading
    edges = [BITS * i // n for i in range(n + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [[parts[i] for i in first] + [p for i, p in enumerate(parts) if i not in first] for first in combinations(range(n), leading)]


def _turned(codes: np.ndarray, arm: Arm, back: bool = False) -> np.ndarray:
    """The codes with their blocks in the arm's order, or put back from it."""
    out, at = np.zeros(len(codes), dtype=np.uint64), 0
    for offset, width in arm:
        a, b = (at, offset) if back else (offset, at)
        mask = np.uint64((1 << width) - 1)
        out |= ((codes >> np.uint64(BITS - a - width)) & mask) << np.uint64(BITS - b - width)
        at += width
    return out


def near_links(prints: DataFrame, budget: int = 4, leading: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``budget`` differing bits.

    ``prints`` has one row for each distinct fingerprint (``print`` long); a
    null one links with nothing, an empty table gives no links.  ``leading``
    blocks of an arm are equal in a subtree; as many as keep an average
    subtree within a tile are taken if none are named, and the links are the
    same for any.  Of the pairs found in a task only a spanning forest is
    kept, which has the same components; no group is written out pair by pair.
    """
    prints = prints.filter("print is not null")
    if leading is None:
        n = prints.count()
        leading = next((k for k in (1, 2, 3) if n >> (BITS * k // (budget + k)) <= TILE), 4)
    parts = arms(budget, leading)
    blocks = []
    for i, arm in enumerate(parts):
        block = F.lit(0).cast("long")
        for offset, width in arm[:leading]:
            block = F.shiftleft(block, width).bitwiseOR(F.shiftrightunsigned(F.shiftleft("print", offset), BITS - width))
        blocks.append(F.struct(F.lit(i).alias("arm"), block.alias("block")))
    dealt = prints.select("print", F.explode(F.array(*blocks)).alias("k")).select("print", "k.arm", "k.block")
    large = (
        dealt.groupBy("arm", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
        .select("arm", "block", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    )
    tiled = (
        dealt.join(large, ["arm", "block"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("arm", "block", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "print")
    )
    keys = ["arm", "block", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            arms_, t1, t2, codes = rows[0], rows[2], rows[3], rows[4]
            tile = (arms_.astype(np.int64) << 48) ^ (t1.astype(np.int64) << 24) ^ t2
            for one in np.unique(tile):  # rows of several blocks, of one arm and tile number, are one trie
                here = tile == one
                arm = parts[int(arms_[here][0])]
                turned = np.sort(_turned(codes[here], arm))
                labels = np.arange(len(turned))
                for i, j in trie_pairs(turned, sum(w for _, w in arm[:leading]), budget):
                    merge_labels(labels, i, j)
                linked = np.flatnonzero(labels != np.arange(len(labels)))
                back = _turned(turned, arm, back=True)
                out.append((back[labels[linked]].view(np.int64), back[linked].view(np.int64)))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            new[4] = new[4].astype(np.int64).view(np.uint64)
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) > TASK_ROWS:
                change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:4]], axis=0))
                if len(change):
                    at = change[-1] + 1
                    yield links([x[:at] for x in held])
                    held = [x[at:] for x in held]
        if held is not None and len(held[0]):
            yield links(held)

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def with_fingerprint(docs: DataFrame, *keep, width: int = 4) -> DataFrame:
    """The columns ``keep`` and ``print``, the fingerprint as a long.

    One row for each row of ``docs``, repeated or not.  Null and empty texts
    have fingerprint 0; very long texts are hashed block by block, whole.
    Names in ``keep`` may be any; further columns are ignored.
    """
    names = [c if isinstance(c, str) else f"_{i}" for i, c in enumerate(keep)]
    narrow = docs.select(*keep, F.col("text").cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", print long"
    names = [f.name for f in narrow.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(x, width) for x in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes.view(np.int64))], names=[*names, "print"])

    return narrow.mapInArrow(run, schema)


def classes(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(print, head): each distinct fingerprint and the head fingerprint of its class.

    Rows of equal fingerprints count once; further columns are ignored; an
    empty table gives an empty result.
    """
    distinct = prints.select("print").distinct()
    found = connected_components(near_links(distinct, budget))
    return distinct.join(found.withColumnRenamed("node", "print"), "print", "left").select(
        "print", F.coalesce("component", "print").alias("head")
    )
