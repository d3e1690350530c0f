"""Divergence of sources within a language, by streams of sorted runs.

Each task sorts its documents' terms by (term, lang, source, document) and
scans the runs: a run of (lang, source, term) yields its number of documents
and occurrences, so what is shuffled is one row for each run and task, however
hot a term is.  These rows are dealt by (lang, term), sorted by (lang, term,
source, task) and scanned again: a run of (lang, term) now has all its
documents, and is kept if there are enough of them.

The kept runs are dealt and sorted once more, behind the sizes of all sources.
A scan lays the runs out as vectors over a language's sources, and yields a
partial sum for each pair of sources and the heaviest terms of each source.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, written

SCALE = 1_000_000_000
SMOOTHING = 5
#: Runs that a task holds before it passes them on.
HELD_RUNS = 1_000_000
#: Places of a matrix (terms x sources, or sources x sources) that a task holds.
HELD_PLACES = 2_000_000

#: Every byte that is part of a term as itself, A-Z as a-z, all others as a space.
LETTERS = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUNS = "lang string, source string, term string, task long, docs long, n long"
KEPT = "lang string, source string, term string, n long, first boolean"
FOUND = "part string, lang string, source string, item string, value long"


class _Numbers(dict):
    """Numbers given to keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _starts(*changed: np.ndarray) -> np.ndarray:
    """Where runs start, given where any column differs from the row before."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce(changed)])


def _changes(column: pa.Array) -> np.ndarray:
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each one's values."""
    key, *values = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(key):
        return (key, *values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _starts(key[1:] != key[:-1])
    return (key[at], *(np.add.reduceat(v[order], at) for v in values))


def _document_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to ``RUNS``: the documents and occurrences of each term in this task."""
    task = TaskContext.get().partitionId()
    groups, terms = _Numbers(), _Numbers()
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key, docs, n = held[0]
        named, spelled = list(groups), pa.array(list(terms), pa.binary())
        langs, sources = (pa.array([g[i] for g in named], pa.string()) for i in (0, 1))
        for at in range(0, len(key), 100_000):
            k = key[at : at + 100_000]
            group = pa.array(k & 0x7FFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(group),
                    sources.take(group),
                    spelled.take(pa.array(k >> 31)).cast(pa.string()),
                    pa.array(np.full(len(k), task, dtype=np.int64)),
                    pa.array(docs[at : at + 100_000]),
                    pa.array(n[at : at + 100_000]),
                ],
                names=["lang", "source", "term", "task", "docs", "n"],
            )

    for batch in batches:
        for part in text_slices(batch, 2):
            group = np.array([groups[g] for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], dtype=np.int64)
            words = [t.decode("utf-8", "replace").encode().translate(LETTERS).split() for t in part.column(2).to_pylist()]
            number = terms.__getitem__
            word = np.fromiter(map(number, chain.from_iterable(words)), dtype=np.int64)
            if not len(word):
                continue
            document = np.repeat(np.arange(len(words)), [len(w) for w in words])
            key = word << 31 | group[document]
            order = np.argsort(key, kind="stable")  # documents rise already, so they come second
            key, document = key[order], document[order]
            at = _starts(key[1:] != key[:-1])
            new = np.r_[True, (key[1:] != key[:-1]) | (document[1:] != document[:-1])]
            held.append((key[at], np.add.reduceat(new.astype(np.int64), at), np.diff(np.r_[at, len(key)])))
        if sum(len(h[0]) for h in held) > HELD_RUNS:
            held = [_merged(held)]
            if len(held[0][0]) > HELD_RUNS // 2:
                yield from flush()
                groups, terms, held = _Numbers(), _Numbers(), []
    if held:
        held = [_merged(held)]
        yield from flush()


def _frequent_runs(least: int):
    """A scan of sorted ``RUNS`` that yields ``KEPT``: the terms that ``least`` documents of a language hold."""

    def cut_runs(columns: list) -> tuple:
        """The runs of (lang, term, source): where they start, where terms start among them, documents, occurrences."""
        lang, source, term, docs, n = columns
        term_changes = _changes(lang) | _changes(term)
        at = _starts(term_changes, _changes(source))
        new_term = np.r_[True, term_changes][at]
        return at, new_term, np.add.reduceat(docs, at), np.add.reduceat(n, at)

    def kept(columns: list) -> pa.RecordBatch:
        at, new_term, docs, n = cut_runs(columns)
        of_term = np.add.reduceat(docs, np.flatnonzero(new_term))
        keep = (of_term >= least)[np.cumsum(new_term) - 1]
        rows = pa.array(at[keep])
        return pa.RecordBatch.from_arrays(
            [columns[0].take(rows), columns[1].take(rows), columns[2].take(rows), pa.array(n[keep]), pa.array(new_term[keep])],
            names=["lang", "source", "term", "n", "first"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in (0, 1, 2)] + [batch.column(i).to_numpy() for i in (4, 5)]
            if carry:
                columns = [pa.concat_arrays([a, b]) for a, b in zip(carry[:3], columns[:3], strict=True)] + [
                    np.concatenate([a, b]) for a, b in zip(carry[3:], columns[3:], strict=True)
                ]
            last = int(_starts(_changes(columns[0]), _changes(columns[2]))[-1])
            if last:
                yield kept([c[:last] for c in columns])
            # The last run goes on in the next batch: one row for each of its sources is carried there.
            rest = [c[last:] for c in columns]
            at, _, docs, n = cut_runs(rest)
            carry = [c.take(pa.array(at)) for c in rest[:3]] + [docs, n]
        if carry:
            yield kept(carry)

    return scan


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), in whole numbers: nine digits, three at a time."""
    rest = count.astype(np.int64) + SMOOTHING
    below = total.astype(np.int64) + SMOOTHING * kept
    out = rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return 1 + out


class _Language:
    """The sources of a language, and what a task has found of it."""

    def __init__(self, name: str, slot: int, top: int, places: int):
        self.name, self.slot, self.top, self.places = name, slot, top, places
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.total = self.kept = 0
        self.at: dict[str, int] | None = None
        self.terms = 0
        self.best: list[tuple] = []

    def ready(self) -> None:
        """All sources are known."""
        s = len(self.sources)
        self.at = {x: i for i, x in enumerate(self.sources)}
        self.each = np.array(self.totals, dtype=np.int64)
        self.none = shares(np.zeros(s, dtype=np.int64), self.each, self.kept) if self.kept else np.zeros(s, dtype=np.int64)
        self.sums = np.zeros((s, s), dtype=np.int64) if s * s <= self.places else None

    def pairs(self, first: int, values: np.ndarray) -> pa.RecordBatch:
        others = self.sources[first + 1 :]
        n = len(others)
        return pa.RecordBatch.from_arrays(
            [pa.array(["pair"] * n, pa.string()), pa.array([self.name] * n, pa.string()), pa.array([self.sources[first]] * n, pa.string()), pa.array(others, pa.string()), pa.array(values, pa.int64())],
            names=["part", "lang", "source", "item", "value"],
        )

    def add(self, term: pa.Array, source: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs of terms, in order."""
        if self.at is None:
            self.ready()
        new = np.r_[True, _changes(term)]
        run = np.cumsum(new) - 1
        s = np.array([self.at[x] for x in source], dtype=np.int64)
        p = shares(n, self.each[s], self.kept)
        whole = np.add.reduceat(n, np.flatnonzero(new))
        q = shares(whole, np.full(len(whole), self.total, dtype=np.int64), self.kept)[run]
        over = np.flatnonzero(p > q)
        self.best.append((s[over], (p - q)[over], self.terms + run[over], np.array(term.take(pa.array(over)).to_pylist(), dtype=object)))
        self.terms += int(run[-1]) + 1
        self.prune()
        step = max(1, self.places // len(self.sources))
        for a in range(0, int(run[-1]) + 1, step):
            here = (run >= a) & (run < a + step)
            laid = np.repeat(self.none[:, None], min(step, int(run[-1]) + 1 - a), axis=1)
            laid[s[here], run[here] - a] = p[here]
            for i in range(len(self.sources) - 1):
                apart = np.abs(laid[i + 1 :] - laid[i]).sum(axis=1)
                if self.sums is not None:
                    self.sums[i, i + 1 :] += apart
                else:
                    yield self.pairs(i, apart)

    def prune(self) -> None:
        """Keep the heaviest terms of each source; of equals the first."""
        s, f, at, term = (np.concatenate(c) for c in zip(*self.best, strict=True))
        order = np.lexsort((at, -f, s))
        s = s[order]
        begin = _starts(s[1:] != s[:-1]) if len(s) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)]))
        order = order[rank < self.top]
        self.best = [(s[rank < self.top], f[order], at[order], term[order])]

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.at is None:
            self.ready()
        if self.slot == 0 or (self.terms and self.sums is not None):  # the first slot names all pairs, of whatever value
            for i in range(len(self.sources) - 1):
                yield self.pairs(i, self.sums[i, i + 1 :] if self.sums is not None else np.zeros(len(self.sources) - 1 - i, dtype=np.int64))
        if self.best:
            s, f, _, term = self.best[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["term"] * len(s), pa.string()), pa.array([self.name] * len(s), pa.string()), pa.array([self.sources[i] for i in s], pa.string()), pa.array(term, pa.string()), pa.array(f, pa.int64())],
                names=["part", "lang", "source", "item", "value"],
            )


def _compare(top: int, places: int):
    """A scan of (slot, lang, kind, term, source, n, total, kept), sources of a language first, that yields ``FOUND``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        carry: tuple | None = None

        def whole_runs(term: pa.Array, source: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal carry
            if carry:
                term, source, n = pa.concat_arrays([carry[0], term]), carry[1] + source, np.concatenate([carry[2], n])
            last = int(_starts(_changes(term))[-1])
            carry = term[last:], source[last:], n[last:]
            if last:
                yield from now.add(term[:last], source[:last], n[:last])

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal carry
            if carry:
                yield from now.add(*carry)
                carry = None
            if now:
                yield from now.done()

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(2).to_numpy()
            at = _starts(_changes(batch.column(1)), kind[1:] != kind[:-1])
            for a, b in zip(at, np.r_[at[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                lang = part.column(1)[0].as_py()
                if now is None or now.name != lang:
                    yield from end()
                    now = _Language(lang, part.column(0)[0].as_py(), top, places)
                if kind[a] == 0:
                    now.sources += part.column(4).to_pylist()
                    now.totals += part.column(5).to_pylist()
                    now.total, now.kept = part.column(6)[0].as_py(), part.column(7)[0].as_py()
                else:
                    yield from whole_runs(part.column(3), part.column(4).to_pylist(), part.column(5).to_numpy())
        yield from end()

    return scan


def kept_terms(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, source, term, n, first): occurrences of each term that ``least`` documents of its language hold.

    A row for each source that has the term; ``first`` marks one of them.
    Null lang, source and text count as ''.  A row is a document, whatever its
    doc_id.  An empty table gives an empty result.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text")).mapInArrow(_document_runs, RUNS)
    sorted_runs = runs.repartition(n, "lang", "term").sortWithinPartitions("lang", "term", "source", "task")
    return sorted_runs.mapInArrow(_frequent_runs(least), KEPT)


def audit(docs: DataFrame, least: int = 30, top: int = 50, places: int = HELD_PLACES) -> DataFrame:
    """How far each source of a language is from its others, and the terms that set it apart.

    ``docs`` (text, lang, source).  Returns lang, source, part, item, value,
    rank: part ``pair`` has a row for each other source of the language, part
    ``term`` the ``top`` terms more frequent in the source than in the
    language.  Null lang, source and text count as ''; a language without
    kept terms has pairs of value 0; a group without terms counts 0 for all.
    Ties are ranked by item.  Texts of any length are read whole, repeated
    rows count as often as they occur, an empty table gives an empty result,
    and further columns are ignored.  A task holds ``places`` sums of pairs of
    a language's sources at most; with more pairs it passes partial sums on.
    Counts must stay below 9e15.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    kept = written(kept_terms(docs, least))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if("first").alias("kept"))
    groups = (
        docs.select(blank("lang"), blank("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "total", "kept"])
    )
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = F.lit(0).cast("long")
    sizes = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "lang", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", "n", "total", "kept"
    )
    rows = kept.select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(slots)).cast("int").alias("slot"), "lang", F.lit(1).alias("kind"), "term", "source", "n", nothing.alias("total"), nothing.alias("kept")
    )
    dealt = sizes.unionByName(rows).repartitionById(slots, "slot").sortWithinPartitions("lang", "kind", "term", "source")
    found = dealt.mapInArrow(_compare(top, places), FOUND)
    ends = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = found.select("part", "lang", F.explode(ends.otherwise(F.array(F.struct("source", "item")))).alias("e"), "value")
    summed = both.groupBy("lang", "part", F.col("e.source").alias("source"), F.col("e.item").alias("item")).agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
