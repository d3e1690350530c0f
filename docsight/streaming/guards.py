"""Stream guards: fragments and patterns that must not appear in a stream of text deltas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def first_leak(deltas: DataFrame, key: str, order: str, text: str, fragments: list[str]) -> DataFrame:
    """Batch form: (key, cut), the 0-based place of the first fragment in a stream's whole text."""
    whole = deltas.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("t"))
    found = [F.nullif(F.instr("t", f), F.lit(0)) for f in fragments]
    at = F.least(*found) if len(found) > 1 else found[0]
    return whole.select(key, (at - 1).cast("long").alias("cut")).filter("cut is not null")


# Shapes and names of commands and of doses that a refused request must not be answered with.
COMMAND_SHAPES = (
    r"rm\s+-[a-z]*r[a-z]*f[a-z]*", r"del\s+/(?:f|s|q)", r"rmdir\s+/s\s*/q", r"format\s+(?:[a-z]:|/q)", r"dd\s+if=/dev/(?:zero|urandom)",
    r"mkfs\.[a-z0-9]+", r"reg\s+delete", r">\s*/dev/sd[a-z]",
)
DOSE_SHAPES = (r"\d+\s*(?:mg|ml|克|毫克|片|粒)", r"[一二三四五六七八九十]+\s*片", r"(?:药片|片剂|胶囊|口服液|混悬液|滴剂|糖浆)")
COMMAND_NAMES = (
    "rm -rf", "rm -fr", "rm -r -f", "del /f /s", "del /s /q", "rmdir /s /q", "format c:", "diskpart", "mkfs", "fdisk", "reg delete",
    "dd if=/dev/zero", "dd if=/dev/urandom", ":(){",
)
DRUG_NAMES = (
    "布洛芬", "对乙酰氨基酚", "扑热息痛", "阿司匹林", "阿莫西林", "头孢", "泰诺", "芬必得", "美林", "感冒灵", "板蓝根", "快克", "感康",
    "蒙脱石散", "黄连素", "藿香正气", "双黄连", "吗丁啉",
)


@dataclass(frozen=True)
class Guard:
    """What must not appear in a stream: patterns, then fragments, each a (kind, text); earlier ones are reported first.

    ``keeps`` lets a delta pass up to the hit, else none of it passes.
    ``only`` names a flag column of the deltas for which alone the guard stands.
    """

    name: str
    fragments: tuple[tuple[str, str], ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()
    keeps: bool = True
    only: str | None = None


def content_guard(only: str | None = None) -> Guard:
    """Commands and doses, for deltas that answer a refused request."""
    shapes = [("command", p) for p in COMMAND_SHAPES] + [("drug", p) for p in DOSE_SHAPES]
    return Guard("content", tuple([("command", n) for n in COMMAND_NAMES] + [("drug", n) for n in DRUG_NAMES]), tuple(shapes), only=only)


class Watch:
    """One stream under guards in their order, given what it has said so far.

    All fragments of all guards are found in one pass of an automaton over
    the new delta and as much text before it as a hit can reach back.
    """

    def __init__(self, guards: list[Guard], reach: int):
        import ahocorasick

        self.guards = guards
        self.rules: list[tuple[int, int, str, str, re.Pattern | None]] = []
        for g, guard in enumerate(guards):
            self.rules += [(g, i, kind, p, re.compile(p)) for i, (kind, p) in enumerate(guard.patterns)]
            self.rules += [(g, len(guard.patterns) + i, kind, f, None) for i, (kind, f) in enumerate(guard.fragments)]
        if not self.rules:
            raise ValueError("no fragments and no patterns")
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for r, rule in enumerate(self.rules):
            if rule[4] is None:
                by_text.setdefault(rule[3], []).append(r)
        for text, rules in by_text.items():
            self.automaton.add_word(text, (len(text), rules))
        if by_text:
            self.automaton.make_automaton()
        longest = max(map(len, by_text), default=1)
        self.keep = max(longest - 1, reach if any(r[4] for r in self.rules) else 0)

    def step(self, tail: str, delta: str, flags: dict) -> tuple[str, str, tuple[str, str, str] | None]:
        """(what passes, the tail to keep, the hit as guard, kind and text)."""
        whole = tail + delta
        stands = [g.only is None or bool(flags.get(g.only)) for g in self.guards]
        first: dict[int, tuple[int, str]] = {}
        if len(self.automaton):
            for end, (n, rules) in self.automaton.iter(whole):
                for r in rules:
                    first.setdefault(r, (end + 1 - n, whole[end + 1 - n : end + 1]))
        for r, (g, _, _, _, pattern) in enumerate(self.rules):
            if pattern is not None and stands[g] and (m := pattern.search(whole)):
                first[r] = (m.start(), m.group())
        hit = min((self.rules[r][:3], at, text) for r, (at, text) in first.items() if stands[self.rules[r][0]]) if any(stands[self.rules[r][0]] for r in first) else None
        if hit is None:
            return delta, whole[-self.keep :] if self.keep else "", None
        (g, _, kind), at, text = hit
        return delta[: max(0, at - len(tail))] if self.guards[g].keeps else "", "", (self.guards[g].name, kind, text)


PASSED = "passed string, guard string, kind string, fragment string"


def _shape(deltas: DataFrame, key: str) -> str:
    return f"{key} {deltas.schema[key].dataType.simpleString()}, {PASSED}"


def guarded(deltas: DataFrame, key: str, order: str, text: str, guards: list[Guard], reach: int = 256) -> DataFrame:
    """Batch form: a row for each delta (key, passed, guard, kind, fragment) until a stream is shut by a hit.

    The streams of a task are read one after another in order; only the tail
    of the one at hand is held.  Null texts count as empty, null keys are a
    stream of their own, an empty table gives an empty result.  Patterns must
    match within ``reach`` characters.
    """
    Watch(guards, reach)  # fails here rather than in a task
    flags = sorted({g.only for g in guards if g.only})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        watch, now, tail, shut, started = Watch(guards, reach), None, "", False, False
        for frame in frames:
            rows = []
            for k, delta, *own in zip(*(frame[c] for c in ("k", "t", *flags)), strict=True):
                k = None if k is None or k != k else k
                if not started or k != now:
                    now, tail, shut, started = k, "", False, True
                if not shut:
                    passed, tail, hit = watch.step(tail, delta or "", dict(zip(flags, own, strict=True)))
                    shut = hit is not None
                    rows.append((k, passed, *(hit or (None, None, None))))
            yield pd.DataFrame(rows, columns=[key, "passed", "guard", "kind", "fragment"], dtype=object)

    narrow = deltas.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(order).alias("o"), *flags)
    dealt = narrow.repartition("k").sortWithinPartitions("k", "o").drop("o")
    return dealt.mapInPandas(run, _shape(deltas, key))


def guard_stream(
    deltas: DataFrame, key: str, order: str, text: str, guards: list[Guard], reach: int = 256, idle_ms: int = 600_000, last: str | None = None
) -> DataFrame:
    """Streaming form of :func:`guarded`; deltas of a micro-batch are taken in their order.

    A stream's state is the tail of its text, and once it is shut the mark
    that it is.  The state is removed when a delta with the flag ``last``
    comes or when none has come for ``idle_ms``; after that the key is a new
    stream.  Needs the RocksDB state store.  Timers keep a query running, so
    one that is to end is stopped, not triggered by what is available.
    """
    Watch(guards, reach)
    flags = sorted({g.only for g in guards if g.only})

    class Guarding(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("stream", "tail string, shut boolean")
            self.watch = Watch(guards, reach)

        def _forget(self) -> None:
            self.state.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

        def handleInputRows(self, key_, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            tail, shut = self.state.get() if self.state.exists() else ("", False)
            out, over = [], False
            for row in pd.concat(list(rows)).sort_values(order, kind="stable").to_dict("records"):
                if not shut:
                    passed, tail, hit = self.watch.step(tail, row[text] or "", {f: row[f] for f in flags})
                    shut = hit is not None
                    out.append((key_[0], passed, *(hit or (None, None, None))))
                if last and row[last]:
                    tail, shut, over = "", False, True
                else:
                    over = False
            self._forget()
            if not over:
                self.state.update((tail, shut))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            yield pd.DataFrame(out, columns=[key, "passed", "guard", "kind", "fragment"], dtype=object)

        def handleExpiredTimer(self, key_, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            yield pd.DataFrame([], columns=[key, "passed", "guard", "kind", "fragment"], dtype=object)

        def close(self) -> None:
            pass

    return deltas.groupBy(key).transformWithStateInPandas(Guarding(), _shape(deltas, key), "Append", "processingTime")


def finished_cases(attempts: DataFrame, case: str, passed: str, expected: int) -> DataFrame:
    """(case, n, passed) of cases all of whose ``expected`` attempts have come; on a stream in update mode as the last one comes."""
    return attempts.groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed")).filter(F.col("n") >= expected)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event-time counts by type, with a watermark; works on batch and stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
