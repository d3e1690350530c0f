"""Clock, files, sessions and graph checks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from docsight.functions import clock
from docsight.operators import cite
from docsight.operators import graph as gr
from docsight.operators import session as se
from docsight.sources import files


@pytest.mark.parametrize(
    ("base", "delta", "want", "day", "part"),
    [
        ("2026-08-31 10:25:28", "+10d", "2026-09-10 10:25:28", "星期四", "上午"),
        ("now: 2024-02-28T23:30 (x)", "+2h30m", "2024-02-29 02:00:00", "星期四", "凌晨"),
        ("2024-03-01", "-1d 5 s", "2024-02-29 00:00:05", "星期四", "凌晨"),
        ("2024-03-01 12:00", "soon", "2024-03-01 12:00:00", "星期五", "中午"),
        ("2024-02-31", "+1d", None, None, None),
        ("", "+1d", None, None, None),
        (None, "+1d", None, None, None),
    ],
)
def test_shift(spark, base, delta, want, day, part):
    t = clock.shifted(F.col("b"), F.col("d"))
    r = spark.createDataFrame([(base, delta)], "b string, d string").select(F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"), clock.weekday(t).alias("w"), clock.period(t).alias("p")).first()
    assert tuple(r) == (want, day, part)


def test_file_selection(spark):
    paths = ["a.md", "b/c.TXT", "b/chapter10.md", "chapter2.md", "index.md", "x.png", "noext", "a.md", None]
    rows = [(s, p) for s in ("A", "B", None) for p in paths]
    out = files.select_files(spark.createDataFrame(rows, "source string, path string"), {"B": ["*.md", "b/?.TXT"]}, ["**/*"], ["index.md"]).collect()
    by = {s: [r["path"] for r in sorted(out, key=lambda r: r["place"]) if r["source"] == s] for s in ("A", "B", None)}
    assert by["A"] == by[None] == ["index.md", "chapter2.md", "b/chapter10.md", "a.md", "b/c.TXT"]
    assert by["B"] == ["index.md", "chapter2.md", "a.md", "b/c.TXT"]


def test_notes_keep_the_last_content(spark):
    rows = [(1, "t", "old", 1), (1, "t", "new", 2), (2, "t", "old", 1), (1, "u", None, 3)]
    state = se.notes(spark.createDataFrame(rows, "s int, title string, content string, k int"), "s", "title", "content", "k")
    assert {tuple(r) for r in state.collect()} == {(1, "t", "new"), (2, "t", "old"), (1, "u", None)}
    assert {r["s"] for r in se.find_notes(state, "title", "content", " old ").collect()} == {2}
    assert se.find_notes(state, "title", "content", "  ").count() == 0


def test_criteria_with_nulls(spark):
    schema = "status string, elapsed_ms double, timeout_sec int, output string, expected_tools array<string>, tool_calls array<string>, trace_types array<string>, answer_contains array<string>, max_rounds int"
    rows = [("ok", 900.0, 1, "ab", ["x", "y"], ["y"], ["done"], ["a", "b"], 1), (None,) * 9, ("ok", 1001.0, 1, "ab", [], [], ["done", "guardrail"], [], 0)]
    names = ("tool_used", "tool_not_used", "stream_complete", "latency_budget", "no_prompt_leak", "contains_all", "within_rounds")
    got = [tuple(r[n] for n in names) for r in se.machine_criteria(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("pass", "fail", "pass", "pass", "pass", "pass", "pass"),
        ("fail", "fail", "fail", "fail", "fail", "na", "fail"),
        ("fail", "pass", "pass", "fail", "fail", "na", "pass"),
    ]


def test_hierarchy(spark):
    c = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 9), (5, -1)], "community int, parent int")
    assert {tuple(r) for r in gr.hierarchy_check(c).collect()} == {(1, "root", 2), (4, "dangling", 0), (5, "root", 0)}


def test_tool_calls_and_rounds_from_a_stream(spark, tmp_path):
    frames = [(1, 0, 0, "a", None, "f", "{\"x\""), (1, 1, 0, None, None, None, ":1}"), (1, 2, 1, "b", "", "g", "{"), (2, 0, 0, "c", None, "h", None)]
    schema = "stream int, k int, index int, id string, type string, name string, arguments string"
    for i, row in enumerate(frames):
        spark.createDataFrame([row], schema).withColumn("ts", F.lit(f"2024-01-01 00:00:0{i}").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
    stored = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, make in (("calls", lambda d: cite.tool_calls(d, "stream", "k")), ("rounds", lambda d: se.round_summary(d, "stream", "index", "ts", "arguments"))):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.awaitTermination(120)
        want = sorted(map(str, make(stored).collect()))
        assert sorted(map(str, spark.table(name).collect())) == want and len(want) == 3
    valid = {(r["stream"], r["index"]): r["valid"] for r in spark.table("calls").collect()}
    assert valid == {(1, 0): True, (1, 1): False, (2, 0): True}


def test_page_chunks_are_places_of_the_section(spark):
    from docsight.plans import load

    pages = spark.createDataFrame([(1, "<h1>A</h1><p>one<p>two two<h2>B</h2><p>three</p>"), (2, None), (3, "")], "id int, html string")
    rows = load.page_chunks(pages, "id", "html", 8).collect()
    got = sorted((r["id"], r["path"], r["seq"], r["start"], r["end"], r["text"]) for r in rows)
    assert got == [(1, "A", 0, 0, 3, "one"), (1, "A", 1, 4, 11, "two two"), (1, "A / B", 0, 0, 5, "three")]
