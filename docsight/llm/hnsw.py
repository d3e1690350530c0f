"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Every two shards meet once: the vectors of one query the graph of the other,
the shards taking turns, and a shard's vectors query its own graph, where a
link counts whichever of its ends finds it.  A beam
that comes back full of links is widened until its worst entry is no link any
more, and a shard's least beam is doubled until an audit passes: of probes
made at exactly the threshold's distance from known vectors, each must find
what brute force finds.  Links are verified by cosine in double precision and
count for both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components, merge_labels

MIN_SHARDS = 12
#: Vectors in a shard at most; more vectors make more shards.
SHARD_ROWS = 500_000
FIRST_BEAM = 16
AUDIT_PROBES = 128
AUDIT_RECALL = 0.98
#: Stand-ins for null vec_ids begin here.
NO_ID = 1 << 62
#: Single precision may differ from double precision by so much.
SLACK = 1e-4


class Graph:
    """An HNSW index of unit vectors, built and searched by many beams in lockstep."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 32, seed: int = 7):
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 8)
        self.levels = levels
        self.links, self.beam = links, beam
        self.graph = [np.full((n, 2 * links if i == 0 else links), -1, dtype=np.int32) for i in range(int(levels.max(initial=0)) + 1)]
        order = np.lexsort((rng.random(n), -levels))  # from the top: the first vector is the entry
        self.entry = int(order[0]) if n else -1
        at, size = min(1, n), 1
        while at < n:
            self._insert(order[at : at + size])
            at += size
            size = min(256, at)

    def _lanes(self) -> int:
        return max(16, min(512, (1 << 26) // max(1, len(self.x))))

    def _layer(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the best ``beam`` nodes reached in a layer, by falling similarity; -1 where there are fewer."""
        lanes, near = np.arange(len(q)), self.graph[level]
        ids = np.full((len(q), beam), -1, dtype=np.int32)
        sims = np.full((len(q), beam), -np.inf, dtype=np.float32)
        done = np.ones((len(q), beam), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start]), False
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        seen[lanes, start] = True
        step = 1 if beam == 1 else 4
        while True:
            waiting = np.where(done, -np.inf, sims)
            lane = lanes[np.isfinite(waiting).any(axis=1)]
            if not len(lane):
                return ids, sims
            w = waiting[lane]
            pick = np.argpartition(-w, min(step, beam) - 1, axis=1)[:, :step] if beam > step else np.tile(np.arange(beam), (len(lane), 1))
            real = np.isfinite(np.take_along_axis(w, pick, axis=1))
            done[lane[:, None], pick] = True
            new = np.where(real[:, :, None], near[ids[lane[:, None], pick]], -1).reshape(len(lane), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            row, col = np.nonzero(new >= 0)
            fresh = ~seen[lane[row], new[row, col]]
            row, col = row[fresh], col[fresh]
            node = new[row, col]
            seen[lane[row], node] = True
            found = np.full(new.shape, -np.inf, dtype=np.float32)
            found[row, col] = np.einsum("ij,ij->i", q[lane[row]], self.x[node])
            all_sims = np.concatenate([sims[lane], found], axis=1)
            all_ids = np.concatenate([ids[lane], new], axis=1)
            all_done = np.concatenate([done[lane], np.zeros(new.shape, dtype=bool)], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[lane] = np.take_along_axis(all_sims, best, axis=1)
            ids[lane] = np.where(np.isfinite(sims[lane]), np.take_along_axis(all_ids, best, axis=1), -1)
            done[lane] = np.take_along_axis(all_done, best, axis=1) | ~np.isfinite(sims[lane])

    def search(self, q: np.ndarray, beam: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(q), self.entry, dtype=np.int32)
        for level in range(len(self.graph) - 1, down_to, -1):
            start = self._layer(q, start, level, 1)[0][:, 0]
        return self._layer(q, start, down_to, beam)

    def _insert(self, nodes: np.ndarray) -> None:
        inside = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(inside, -np.inf)
        for level in range(int(self.levels[nodes].max()), -1, -1):
            here = self.levels[nodes] >= level
            batch = nodes[here]
            if level and self.levels[self.entry] < level:
                continue
            ids, sims = self.search(self.x[batch], self.beam, level)
            own = inside[np.ix_(here, here)]
            k = min(self.beam, len(batch))
            mates = np.argsort(-own, axis=1, kind="stable")[:, :k]
            ids = np.concatenate([ids, batch[mates].astype(np.int32)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, mates, axis=1).astype(np.float32)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = self._diverse(ids, sims, self.links)
            self.graph[level][batch, : self.links] = chosen
            for node, row in zip(batch, chosen, strict=True):
                self._link_back(node, row[row >= 0], level)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, those nearer to the row than to any already chosen; then the best others."""
        vectors = self.x[np.maximum(ids, 0)]
        between = np.einsum("ijk,ilk->ijl", vectors, vectors)
        real = np.isfinite(sims) & (ids >= 0)
        chosen, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(ids), dtype=int)
        closest = np.full(ids.shape, -np.inf, dtype=np.float32)
        for j in range(ids.shape[1]):
            take = real[:, j] & (count < most) & (sims[:, j] >= closest[:, j])
            chosen[:, j] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j, :]), closest)
        rank = np.where(chosen, 0, np.where(real, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        first = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(real, first, axis=1), np.take_along_axis(ids, first, axis=1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, node: int, others: np.ndarray, level: int) -> None:
        near = self.graph[level]
        free = (near[others] < 0).any(axis=1)
        room = others[free]
        near[room, (near[room] < 0).argmax(axis=1)] = node
        full = others[~free]
        if len(full):
            ids = np.concatenate([near[full], np.full((len(full), 1), node, dtype=np.int32)], axis=1)
            sims = np.einsum("ijk,ik->ij", self.x[ids], self.x[full])
            order = np.argsort(-sims, axis=1, kind="stable")
            near[full] = self._diverse(np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), near.shape[1])


class Shard:
    """The graph of one shard's vectors of one length, with an audited beam."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, threshold: float):
        self.ids, self.weights, self.threshold = ids, weights, threshold
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.graph = Graph(self.unit)
        self.beam, self.recall = self._audit()

    def _audit(self) -> tuple[int, float]:
        rng = np.random.default_rng(11)
        n, d = self.unit.shape
        base = self.unit[rng.permutation(n)[:AUDIT_PROBES]]
        aside = rng.standard_normal(base.shape)
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)
        c = min(1.0, self.threshold + 1e-6)
        probes = c * base + np.sqrt(1 - c * c) * aside if d > 1 else base
        probes /= np.linalg.norm(probes, axis=1, keepdims=True)
        true = (probes @ self.unit.T >= self.threshold).sum(axis=1)
        beam = FIRST_BEAM
        while True:
            found = np.zeros(len(probes))
            for i, _ in self.links(probes, beam):
                found += np.bincount(i, minlength=len(probes))
            # The mean over probes: a large cluster's probes count as one each.
            recall = float((found[true > 0] / true[true > 0]).mean()) if true.any() else 1.0
            if recall >= AUDIT_RECALL or beam >= n:
                return beam, recall
            beam *= 2

    def links(self, unit: np.ndarray, beam: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, positions in the shard) of verified links, in blocks of queries."""
        lanes = self.graph._lanes()
        for at in range(0, len(unit), lanes):
            rows, width = np.arange(at, min(at + lanes, len(unit))), beam or self.beam
            while len(rows):
                ids, sims = self.graph.search(unit[rows].astype(np.float32), width)
                full = (ids[:, -1] >= 0) & (sims[:, -1] >= self.threshold - SLACK) & (width < len(self.ids))
                q, c = np.nonzero((sims >= self.threshold - SLACK) & (ids >= 0) & ~full[:, None])
                i, j = rows[q], ids[q, c]
                good = np.einsum("ij,ij->i", unit[i], self.unit[j]) >= self.threshold
                yield i[good], j[good]
                rows, width = rows[full], width * 4


    def own_links(self) -> tuple[np.ndarray, np.ndarray]:
        """For each of the shard's vectors the weight of those it links with, and the smallest position of its class.

        A pair counts once for each of its ends, whichever end's search found
        it.  Pairs are not kept: what was found from a vector and what was
        found to it are summed as hashes, and only vectors whose sums differ
        are searched again for the pairs that one end alone found.
        """
        n = len(self.ids)
        count, labels = np.zeros(n, dtype=np.int64), np.arange(n)
        gone, come = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for i, j in self.links(self.unit):
            i, j = i[i != j], j[i != j]
            key = (np.minimum(i, j) * n + np.maximum(i, j)).astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                np.add.at(gone, i, key)
                np.add.at(come, j, key)
            np.add.at(count, i, self.weights[j])
            merge_labels(labels, i, j)
        odd = np.flatnonzero(gone != come)
        is_odd = gone != come
        found = [np.zeros(0, dtype=np.int64)]
        for i, j in self.links(self.unit[odd]):
            i = odd[i]
            both = is_odd[j] & (i != j)
            found.append(i[both] * n + j[both])
        pairs = np.concatenate(found)
        lone = pairs[~np.isin(pairs % n * n + pairs // n, pairs)] if len(pairs) else pairs
        np.add.at(count, lone % n, self.weights[lone // n])
        return count, labels


def usable(column: str) -> Column:
    """True for a vector without null or non-finite components and not all zero."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad & F.exists(column, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Links of ``vectors`` (vec_id, embedding) at cosine >= ``threshold``.

    Returns one row for each row: vec_id, n_links, component_id (smallest
    vec_id reachable), kept.  Equal vectors are indexed once, linked with one
    another and counted as often as they occur.  A vector that is null,
    empty or zero or holds null or non-finite components links with nothing;
    vectors of different lengths do not link.  Rows of null vec_id count as
    links of others, name no component and have a null component_id.  An
    empty table gives an empty result.  Further columns, labels too, are
    ignored.  Vec_ids are below 2 ** 62.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    held_as = "array<float>" if element == "float" else "array<double>"  # what the column holds, exactly
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(usable("embedding"), F.col("embedding").cast(held_as)).alias("v"),
    ).withColumn("key", F.md5(F.col("v").cast("string").cast("binary")))
    groups = cut(
        rows.filter("key is not null").groupBy("key").agg(
            # A vector that only rows of null vec_id hold stands above all vec_ids, so it names no class of others.
            F.coalesce(F.min("vec_id"), F.lit(NO_ID) + F.pmod(F.xxhash64("key"), F.lit(1 << 61))).alias("head"),
            F.count(F.lit(1)).alias("times"),
            F.any_value("v").alias("v"),
        )
    )
    shards = max(MIN_SHARDS, -(-groups.count() // SHARD_ROWS))
    base = groups.select(F.pmod(F.xxhash64("head"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "head", "times", "v")
    # Shard a asks the half of the shards that follow it, so any two meet once; its own vectors it holds already.
    home = F.pmod(F.xxhash64("head"), F.lit(shards)).cast("int")
    ahead = F.filter(F.sequence(F.lit(1), F.lit(shards // 2)), lambda s: (2 * s < shards) | (home < shards // 2))
    asks = (
        groups.select(home.alias("home"), F.explode(ahead).alias("step"), "head", "times", "v")
        .select(F.pmod(F.col("home") + F.col("step"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("asks"), "head", "times", "v")
    )
    dealt = base.unionByName(asks).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], {}

        def shown(out: list) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n"])

        def tell(names: np.ndarray, count: np.ndarray, labels: np.ndarray, out: list) -> None:
            some = count > 0
            out.append((names[some], names[some], count[some]))
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            out.append((names[linked], names[labels[linked]], np.zeros(len(linked), dtype=np.int64)))

        def answer(ids: np.ndarray, times: np.ndarray, values: list, out: list) -> None:
            sizes = np.array([len(v) for v in values])
            for d in np.unique(sizes):
                if int(d) not in ready:
                    continue
                at, s = np.flatnonzero(sizes == d), ready[int(d)]
                x = np.array([values[i] for i in at], dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own = ids[at]
                everyone, place = np.unique(np.concatenate([s.ids, own]), return_inverse=True)
                labels = np.arange(len(everyone))
                count = np.zeros(len(everyone), dtype=np.int64)
                for i, j in s.links(x):
                    np.add.at(count, place[len(s.ids) + i], s.weights[j])
                    np.add.at(count, place[j], times[at][i])
                    merge_labels(labels, place[len(s.ids) + i], place[j])
                tell(everyone, count, labels, out)

        def build(out: list) -> None:
            ready.clear()
            by: dict[int, list] = {}
            for row in held:
                by.setdefault(len(row[2]), []).append(row)
            for d, own in by.items():
                ids, weights, v = zip(*own, strict=True)
                ready[d] = Shard(np.array(ids, dtype=np.int64), np.array(weights, dtype=np.int64), np.array(v, dtype=np.float64), threshold)
                tell(ready[d].ids, *ready[d].own_links(), out)
            held.clear()

        for batch in batches:
            shard, ask, ids, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            values = batch.column(4)
            out: list = []
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (ask[1:] != ask[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)], strict=True):
                vectors_ = [np.asarray(x.values) for x in values.slice(a, b - a)]
                if shard[a] != now:
                    if held:
                        build(out)
                    now = shard[a]
                    ready.clear()
                if ask[a] == 0:
                    held += zip(ids[a:b], times[a:b], vectors_, strict=True)
                else:
                    if held:
                        build(out)
                    answer(ids[a:b].astype(np.int64), times[a:b].astype(np.int64), vectors_, out)
            yield shown(out)
        if held:  # no other shard's vectors came after it
            build(out := [])
            yield shown(out)

    found = cut(dealt.mapInArrow(run, "a long, b long, n long"))
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("head"), "n")
    parts = connected_components(found.filter("n = 0").select("a", "b")).withColumnRenamed("node", "head")
    known = cut(
        groups.select("key", "head", "times").join(counts, "head", "left").join(parts, "head", "left").select(
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("component", "head").alias("component_id"),
        )
    )
    out = rows.select("vec_id", "key").join(known, "key", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
