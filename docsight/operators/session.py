"""Sessions: notes, rounds of a stream, traces and the criteria a machine can judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def notes(writes: DataFrame, session: str, title: str, content: str, order: str) -> DataFrame:
    """(session, title, content): the last content written under each title; ``order`` must not repeat within a title."""
    return writes.groupBy(session, title).agg(F.max_by(content, order).alias(content))


def find_notes(state: DataFrame, title: str, content: str, keyword: str) -> DataFrame:
    """Notes whose title or content holds the keyword, cleared of white space around it; none for an empty one."""
    word = keyword.strip()
    if not word:
        return state.filter(F.lit(False))
    return state.filter(F.contains(title, F.lit(word)) | F.contains(content, F.lit(word)))


def round_summary(deltas: DataFrame, stream: str, round_: str, at: str, text: str) -> DataFrame:
    """(stream, round, chunks, deltas, chars, bytes, first_ms, duration_ms) of each round of a stream.

    Every row is a chunk; a row whose text is neither null nor empty is a
    delta.  ``first_ms`` runs from the round's first chunk to its first delta
    and is null without one.  One aggregation: the same on a batch and, in
    update mode, on a stream.
    """
    says = F.coalesce(F.col(text) != "", F.lit(False))
    ms = F.unix_micros(F.col(at).cast("timestamp")) / 1000
    return deltas.groupBy(stream, round_).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(says).alias("deltas"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"),
        F.round(F.min(F.when(says, ms)) - F.min(ms), 1).alias("first_ms"),
        F.round(F.max(ms) - F.min(ms), 1).alias("duration_ms"),
    )


def trace_metrics(steps: DataFrame, run: str, order: str, kind: str, name: str) -> DataFrame:
    """(run, tool_calls, trace_types, rounds): names of executed tools in order, distinct kinds of steps, number of rounds."""
    tools = F.array_sort(F.collect_list(F.when(F.col(kind) == "tool_exec", F.struct(order, name))))
    return steps.groupBy(run).agg(
        F.transform(tools, lambda x: x[name]).alias("tool_calls"),
        F.array_sort(F.collect_set(kind)).alias("trace_types"),
        F.count_if(F.col(kind) == "round").alias("rounds"),
    )


def _verdict(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def machine_criteria(attempts: DataFrame) -> DataFrame:
    """Adds a verdict for each criterion that needs no judge.

    ``attempts``: status, elapsed_ms, timeout_sec, output, expected_tools,
    tool_calls, trace_types, answer_contains, max_rounds.  Any expected tool
    is enough; nothing expected fails ``tool_used``; no phrases asked for give
    ``na``.  Nulls fail.
    """
    ok = F.col("status") == "ok"
    phrases = F.forall("answer_contains", lambda p: F.contains(F.col("output"), p))
    asked = F.coalesce(F.size("answer_contains") > 0, F.lit(False))
    return attempts.withColumns(
        {
            "tool_used": _verdict(F.arrays_overlap("expected_tools", "tool_calls")),
            "tool_not_used": _verdict(F.size("tool_calls") == 0),
            "stream_complete": _verdict(ok & F.array_contains("trace_types", "done")),
            "latency_budget": _verdict(ok & (F.col("elapsed_ms") <= F.col("timeout_sec") * 1000)),
            "no_prompt_leak": _verdict(~F.array_contains("trace_types", "guardrail")),
            "contains_all": F.when(asked, _verdict(phrases)).otherwise("na"),
            "within_rounds": _verdict(F.size("tool_calls") <= F.col("max_rounds")),
        }
    )
