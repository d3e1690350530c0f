"""Quality rules as a short-circuit cascade.

Each rule looks at one measure of a text.  On a sample, every rule is run on
every text to estimate its cost and the share it rejects; the cascade then
runs the rules in descending order of rejection per cost, each only on the
texts that all rules before it let pass.  The verdict is the conjunction of
all rules, so the order changes the time and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share

WINDOW = 8
SAMPLE_ROWS = 2000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STARTS_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    index: dict[bytes, int] = {}
    code = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    if len(index) == n:
        return 0
    if len(index) < 50_000 and width >= 4:  # four indexes fit into 64 bits: most texts end here
        k = len(index)
        four = ((code[:-3] * k + code[1:-2]) * k + code[2:-1]) * k + code[3:]
        four.sort()
        if not (four[1:] == four[:-1]).any():
            return 0
    span = 1
    while span < width:  # ranks of windows of twice the span, exactly
        step = min(span, width - span)
        pair = code[:-step] * (int(code.max()) + 1) + code[step:]
        code = np.unique(pair, return_inverse=True)[1]
        span += step
    hit = np.bincount(code)[code] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


class Text:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, data: bytes | None):
        self.data = data or b""

    @cached_property
    def bytes_(self) -> np.ndarray:
        return np.frombuffer(self.data, dtype=np.uint8)

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return int(_STARTS_POINT[self.bytes_].sum()) - int(_WHITE[self.bytes_].sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(_SYMBOL[self.bytes_].sum())

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_window_words(self.words)

    @cached_property
    def letter_words(self) -> int:
        white = _WHITE[self.bytes_]
        starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
        return int(np.logical_or.reduceat(_LETTER[self.bytes_], starts).sum()) if starts.size else 0

    @cached_property
    def digits(self) -> int:
        return int(_DIGIT[self.bytes_].sum())

    @cached_property
    def bullet_lines(self) -> int:
        return sum(x.lstrip().startswith((b"-", b"*", "•".encode())) for x in self.lines)

    @cached_property
    def ellipsis_lines(self) -> int:
        return sum(x.rstrip().endswith((b"...", "…".encode())) for x in self.lines)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to be thrown out."""

    name: str
    rejects: Callable[[Text], bool]


#: The two rules of the base verdict.
BASE = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
#: The further rules; limits are integers times counts, so SQL gives the same verdicts.
RULES = (
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 16 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("letters", lambda t: 10 * t.letter_words < 7 * t.n_words),
    Rule("digits", lambda t: 5 * t.digits > t.word_chars),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("bullets", lambda t: 10 * t.bullet_lines > 9 * len(t.lines)),
    Rule("ellipses", lambda t: 10 * t.ellipsis_lines > 3 * len(t.lines)),
)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...], columns: list[str], text: str = "text") -> list[dict]:
    """Rules with estimated rejection and cost, in the order to run them.

    The sample is about ``SAMPLE_ROWS`` rows, chosen by a hash of
    ``columns``; measures are not shared between rules while timing.  An
    empty sample leaves the rules in the given order.
    """
    n = docs.count()
    sample = docs.filter(hash_share(n, SAMPLE_ROWS, *columns)).select(F.col(text).cast("binary").alias("b"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = rejected = seconds = None
        for batch in batches:
            seen = seen or [0] * len(rules)
            rejected, seconds = rejected or [0] * len(rules), seconds or [0.0] * len(rules)
            for data in batch.column(0).to_pylist():
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(Text(data))
                    seconds[i] += time.perf_counter() - began
                    seen[i] += 1
        if seen:
            yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "seen": seen, "rejected": rejected, "seconds": seconds})

    found = (
        sample.mapInArrow(measure, "rule long, seen long, rejected long, seconds double")
        .groupBy("rule")
        .agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
        .collect()
    )
    figures = {r["rule"]: (r["rejected"] / r["seen"], r["seconds"] / r["seen"]) for r in found}
    out = []
    for i, rule in enumerate(rules):
        share, cost = figures.get(i, (0.0, 1e-9))
        out.append({"rule": rule, "rejected": share, "cost": cost, "gain": share / max(cost, 1e-9)})
    return sorted(out, key=lambda x: (-x["gain"], x["cost"] if x["gain"] == 0 and found else 0))


def first_rejection(text: Text, order: list[Rule]) -> str | None:
    """The name of the first rule that rejects; later ones are not evaluated."""
    return next((rule.name for rule in order if rule.rejects(text)), None)


def rejected_by(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, columns=("doc_id",), text: str = "text") -> DataFrame:
    """Rows of ``docs`` unchanged that pass every rule, as a lazily filtered frame.

    Null texts count as empty; nulls elsewhere, repeated rows and any further
    columns pass through as they are.
    """
    order = [x["rule"] for x in plan_cascade(docs, rules, list(columns), text)]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [first_rejection(Text(x.as_buffer().to_pybytes() if x.is_valid else None), order) is None for x in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure_documents(docs: DataFrame) -> DataFrame:
    """Base measures and verdict of every document.

    Null and empty texts have no words and fail; one row comes back for each
    row of ``docs``, repeated or not; further columns are ignored.
    """
    order = [x["rule"] for x in plan_cascade(docs, RULES, ["doc_id"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                t = Text(data)
                failed = any(rule.rejects(t) for rule in BASE)
                kept = not failed and first_rejection(t, order) is None
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("b")).mapInArrow(run, MEASURES)
