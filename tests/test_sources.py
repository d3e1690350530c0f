"""Sources, stores, citations and the calculator on small, hand-written rows."""

from pyspark.sql import functions as F

from docsight import catalog
from docsight.functions import calc
from docsight.operators import cite
from docsight.sources import files, tables as tb


def test_calculator(spark):
    cases = {
        "3+5": "8", "10/3": "10/3", "19/4": "4.75", "sqrt(144)": "12", "8**(1/3)": "2", "2**-2": "0.25", "-(1/8)": "-0.125", "0.1+0.2": "0.3",
        "sqrt(2)": "1.414213562373", "1/0": None, "": None, "__import__('os')": None, "sqrt(-1)": None, "9**9**9": None, "True": None,
    }
    got = spark.createDataFrame([(e,) for e in [*cases, None]], "e string").select("e", calc.calculator("e").alias("r"))
    rows = {r["e"]: r["r"] for r in got.collect()}
    assert {e: rows[e]["value"] for e in cases} == cases
    assert not rows[None]["ok"] and rows["sqrt(2)"]["ok"] and not rows["sqrt(2)"]["exact"]
    texts = {"10/3": "3.(3)", "365/7": "52.(142857)", "1/6": "0.1(6)", "-1/12": "-0.08(3)"}
    assert {e: calc.calculate(e)[5] for e in texts} == texts
    # 10 is a primitive root modulo 7019; the period is checked by congruence
    long = calc.calculate("1/7019")
    digits = long[5][3:-1]
    assert long[:3] == (True, True, "1/7019") and len(digits) == 7018
    remainder = 0
    for d in digits:
        remainder = (remainder * 10 + int(d)) % (10 ** 9 + 7)
    assert remainder * 7019 % (10**9 + 7) == (pow(10, 7018, 10**9 + 7) - 1) % (10**9 + 7)


def test_decoded(spark):
    rows = [b"\xef\xbb\xbfab", "é".encode(), "中文".encode("gb18030"), b"", None, b"a\xff\xff"]
    got = [r["t"] for r in spark.createDataFrame([(b,) for b in rows], "b binary").coalesce(1).select(tb.decoded(F.col("b")).alias("t")).collect()]
    assert got == ["ab", "é", "中文", "", None, "a\ufffd\ufffd"]


def test_catalog_and_usage(spark):
    lines = [("| A1 | x | n 2023-11 z | u | l | r | c | p;q ; | ✅ |",), ("| - | - |",), ("text",), (None,)]
    (row,) = tb.catalog_rows(spark.createDataFrame(lines, "value string")).collect()
    assert (row["source_id"], row["paths"], row["collected"], row["knowledge_date"]) == ("A1", ["p", "q"], True, "2023-11")
    usage = "2024-01-02T03:04:05Z x [LLM Usage] model=m, purpose=p, prompt_prefix=, prompt_tokens=1, completion_tokens=2, total_tokens=3"
    (row,) = tb.usage_rows(spark.createDataFrame([(usage,), (usage,), ("LLM Usage",)], "value string")).collect()
    assert (row["ts"], row["total_tokens"]) == ("2024-01-02T03:04:05", 3)


def test_line_sections(spark):
    def line(page, n, top, size, text):
        return (1, page, n, 800.0, top, top + size, size, text)

    lines = [
        line(1, 1, 100.0, 30.0, "Cover"),
        line(2, 1, 50.0, 10.0, "before any head-"), line(2, 2, 62.0, 10.0, "ing"),
        line(2, 3, 100.0, 20.0, "A long"), line(2, 4, 122.0, 20.0, "title"),
        line(2, 5, 150.0, 10.0, "one"), line(2, 6, 162.0, 10.0, "more"), line(2, 7, 190.0, 10.0, "two"), line(2, 8, 790.0, 10.0, "7"),
        line(3, 1, 50.0, 10.0, "Contents"), line(3, 2, 62.0, 10.0, "x"),
    ]
    df = spark.createDataFrame(lines, "doc int, page int, line int, page_height double, top double, bottom double, size double, text string")
    got = [(r["path"], r["paragraphs"]) for r in tb.line_sections(df, "doc").orderBy("seq").collect()]
    assert got == [("引言", ["before any heading"]), ("A long title", ["one more", "two"])]
    assert tb.line_sections(df.filter("false"), "doc").count() == 0


def test_versioned_table_and_import(spark, tmp_path):
    table = tb.VersionedTable(spark, str(tmp_path / "runs"), ["id"])
    table.put(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), 1)
    table.put(spark.createDataFrame([(1, "c")], "id int, name string"), 2)
    table.delete(spark.createDataFrame([(2,)], "id int"), 3)
    assert [tuple(r) for r in table.current().collect()] == [(1, "c")]
    table.compact(str(tmp_path / "small"))
    assert [tuple(r) for r in tb.VersionedTable(spark, str(tmp_path / "small"), ["id"]).newest("id", 5).collect()] == [(1, "c")]
    path = str(tmp_path / "statements")
    tb.import_source(spark.createDataFrame([(1, "x"), (2, "y")], "v int, source_id string"), path)
    tb.import_source(spark.createDataFrame([(3, "x")], "v int, source_id string"), path)
    assert sorted((r["v"], r["source_id"]) for r in spark.read.parquet(path).collect()) == [(2, "y"), (3, "x")]


def test_citations(spark):
    claims = spark.createDataFrame([(1, ["[1]", "[1]"]), (2, ["s"]), (3, ["[9]", "s"]), (4, []), (5, None)], "claim_id int, refs array<string>")
    hits = spark.createDataFrame([(1, "r", "b1"), (2, "s", "b2"), (3, "s", "b3")], "position int, source string, block string")
    got = {r["claim_id"]: (r["state"], r["blocks"], r["missing"]) for r in cite.citation_groups(claims, hits).collect()}
    assert got == {1: ("ok", ["b1"], []), 2: ("ok", ["b2", "b3"], []), 3: ("fail", ["b2", "b3"], ["[9]"]), 4: ("uncertain", [], []), 5: ("uncertain", [], [])}


def test_context_and_reason(spark):
    text = "One. Two three. It holds. Four."
    df = spark.createDataFrame([(text, 16, 24)], "t string, a int, b int")
    assert df.select(cite.context_window(F.col("t"), F.col("a"), F.col("b"), 4, 100).alias("w")).first()["w"] == "Two three. It holds."
    reason = lambda *x: spark.range(1).select(cite.unresolved_reason(*map(F.lit, x)).alias("r")).first()["r"]
    assert reason("phrase", "these questions", "We ask. these questions stay", "these questions stay") == "summary"
    assert reason("phrase", "these questions", "Questions arise. these questions stay", "these questions stay") == "recheck"
    assert reason("bare", "it", "x", "y") == "recheck"


def test_tool_calls(spark):
    rows = [("s", 1, 0, "c1", "", "se", '{"q":'), ("s", 2, 0, None, None, "arch", ' 1}'), ("s", 3, 1, "c2", "function", "f", "{bad"), ("s", 4, 2, "c3", "", "g", None)]
    df = spark.createDataFrame(rows, "stream string, n int, index int, id string, type string, name string, arguments string")
    got = [tuple(r) for r in cite.tool_calls(df, "stream", "n").orderBy("index").collect()]
    assert got == [("s", 0, "c1", "function", "search", '{"q": 1}', True), ("s", 1, "c2", "function", "f", "{bad", False), ("s", 2, "c3", "function", "g", "", True)]


def test_rows_have_places_in_the_order_of_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    # the first rows are in the small file, which is not the first to be read
    for name, values in (("a", [7.0, None, 1.0]), ("b", [9.0] * 4000), ("c", [5.0, 8.0])):
        n = len(values)
        pq.write_table(pa.table({"l_linenumber": pa.array([1] * n, pa.int32()), "l_orderkey": pa.array([4] * n, pa.int64()), "l_quantity": pa.array(values, pa.float64())}), tmp_path / f"{name}.parquet")
    pq.write_table(pa.table({"l_linenumber": pa.array([2], pa.int32()), "l_orderkey": pa.array([4], pa.int64()), "l_quantity": pa.array([3.0], pa.float64())}), tmp_path / "d.parquet")
    rows = spark.read.parquet(str(tmp_path))
    assert [r["l_quantity"] for r in files.placed(rows, "l_quantity").orderBy("place").collect()] == [7.0, None, 1.0, *[9.0] * 4000, 5.0, 8.0, 3.0]
    # null is no value; of the others the first counts
    (row,) = catalog.pairwise_stability(lambda _: rows).collect()
    assert (row["run_a"], row["run_b"], row["shared"], row["mean_diff"]) == (1, 2, 1, 4.0)


def test_titles_keep_unfinished_references(spark):
    pages = [(1, "<h1>a &amp;&amp b</h1><p>x</p>"), (2, "<h1>c &lt; &quot;d&quot; &amp;lt;</h1><p>x</p>")]
    got = catalog.page_titles(lambda _: spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {r["page_id"]: r["heading"] for r in got} == {1: "a &&amp b", 2: 'c &lt; "d" &lt;'}
