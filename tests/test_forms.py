"""Forms of names, anaphors, evidence and pieces of long texts, case by case."""

import re

import pytest
from pyspark.sql import functions as F

from docsight.functions import forms as fm
from docsight.functions import naming as nm
from docsight.functions import text as tx
from docsight.operators import compile as cp
from docsight.operators import ingest as ig
from docsight.operators import retrieve as rt
from docsight.operators import runs as rn
from docsight.streaming import guards


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_form_keys(spark):
    pairs = {
        "Databases": "database", "database": "database", "The cases": "case", "houses": "house", "HCS": "hcs", "APIs": "api", "~/.aws/credentials": "~ .aws credentials",
        "Policies": "policy", "boxes": "box", "processes": "process", "glass": "glass", "status": "status", "children": "child", "analyses": "analysis", "means": "means",
        "the a widget": "widget", "Ann's plan": "ann plan", "read-only modes": "read only mode", "v1.2s": "v1.2s", "the": "", "": "", "DNS": "dns", "as": "as",
    }
    assert dict(zip(pairs, values(spark, pairs, fm.form_key))) == pairs
    assert values(spark, ["cats", "cat", "HCS", "series", None], fm.is_plural) == [True, False, False, False, False]


def test_anaphors(spark):
    texts = ["this", "This approach", "it was put away", "a function that returns", "such tools", "there", "they who came", "these are one two three four", "thistle", None]
    kinds = ["bare", "phrase", "embedded", None, "phrase", "bare", "embedded", "embedded", None, None]
    assert [x and x["kind"] for x in values(spark, texts, fm.anaphor)] == kinds


def test_verbatim_evidence(spark):
    window = F.lit("The small cat sat on “the” mat, and the dog slept.")
    said = ["cat sat the mat", "The cat ... the dog slept", "cat sat on", "mat the cat dog", "cat sat on a mat", "", None]
    assert values(spark, said, lambda e: fm.is_verbatim(e, window)) == [True, True, False, False, False, False, False]


def test_first_object_and_keys(spark):
    texts = ['x {"a": "}"} y {"b": 1}', '{"a": {"b": "\\""}}', "none", '{"open": 1', None]
    assert values(spark, texts, fm.first_object) == ['{"a": "}"}', '{"a": {"b": "\\""}}', None, None, None]
    assert values(spark, ['{"k": "b", "l": [{"k": "a"}, {"k": 1}]}', None], lambda x: fm.values_of(x, "k")) == [["a", "b"], []]


def test_phrases_are_used_up(spark):
    found = values(spark, ["red light and red", "light", "none", None], lambda x: fm.phrase_hits(x, {"a": ["red"], "b": ["red light"], "c": ["light"]}))
    assert [f and (f["group"], f["hits"]) for f in found] == [("b", ["red light", "red"]), ("c", ["light"]), None, None]


def test_route_falls_back_and_says_so(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["all of them", "x", "x", "x", "x"])], "id int, text string")
    replies = spark.createDataFrame([(1, "fact", "why", None), (2, "odd", "why", None), (3, "fact", None, "Timeout")], "id int, need string, reason string, error string")
    got = {r["id"]: (r["route"], r["decided_by"], r["degraded"], r["needs_review"]) for r in rn.decide_route(texts, {"list": ["all of"]}, replies, {"list": "graph", "fact": "vector"}).collect()}
    assert got == {0: ("graph", "lexicon", None, False), 1: ("vector", "reply", None, False), 2: ("vector", "default", "unsure", True), 3: ("vector", "default", "error:Timeout", True), 4: ("vector", "default", "unavailable", False)}


def test_name_tiers_and_flips(spark):
    none = F.lit(None).cast("array<string>")
    tier = lambda n, r, d=none: spark.range(1).select(nm.name_tier(F.lit(n), F.lit(r), d)).first()[0]
    assert tier("doc-gardening agents", "its “doc-gardening” agent") == "ok"
    assert tier("high-utility environment", "the environment—high‑utility") == "ok"
    assert tier("auditability", "auditable logs") == "derived"
    assert tier("tooling stack", "compilers and linkers", F.array(F.lit("compilers"), F.lit("linkers"))) == "generalized"
    assert tier("unicorn", "compilers") == "reject" and tier("the of", "the of") == "reject"
    assert values(spark, ["was written by", "is very well known by", "was sent. Stand by", "has been kept safe and driven by", None], nm.is_passive) == [True, False, False, False, False]
    assert values(spark, ["may go", "does not go", "so that it", "goes", "a b c d", None], tx.needs_cleaning) == [True, True, True, False, True, False]


def test_mixed_tokens_find_unspaced_scripts(spark):
    docs = spark.createDataFrame([(1, "分布式系统的设计"), (2, "系统"), (3, "plain text v1.2"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "系统设计"), (8, "v1.2 text")], "query_id long, text string")
    hits = {(r["query_id"], r["id"]) for r in rt.bm25_top_k(asked, docs, tx.mixed_tokens, 5).collect()}
    assert {(7, 1), (8, 3)} <= hits and (7, 3) not in hits
    assert values(spark, ["我们 的 a bb 数据"], tx.mixed_tokens) == [["bb", "数据"]]


def test_html_content():
    page = "<title>T</title><header>Site</header><p>outside of all</p><main><h1>A<h2>B</h2><p>One<p>Two<div>bare text that is long enough</div><div>short</div><h2>Newsletter</h2><p>gone</p><h2>C</h2><p>Accept cookies</p><p>Last</p></main><footer><p>foot</p></footer>"
    assert ig.html_sections(page) == [{"path": "A / B", "paragraphs": ["One", "Two", "bare text that is long enough"]}, {"path": "C", "paragraphs": ["Last"]}]
    assert ig.html_sections("<p>no head, no body") == [{"path": ig.INTRODUCTION, "paragraphs": ["no head, no body"]}]
    assert ig.html_sections("<head><title>x</title><body><article><p>in</p></article><p>out</p>")[0]["paragraphs"] == ["in"]
    assert ig.html_sections("<div><p>a</p></div><div class='content x'><p>b</p></div>") == [{"path": ig.INTRODUCTION, "paragraphs": ["b"]}]
    assert ig.html_sections(None) == []


def test_long_paragraphs_are_split_at_sentences_then_cut(spark):
    text = "One two. Three four! " + "x" * 25 + " End."
    got = ig.long_pieces(text, 20)
    assert all(len(t) <= 20 for t, _, _ in got) and "".join(t for t, _, _ in got) == "One two.Three four! " + "x" * 25 + " End."
    assert all(text[a] == t[0] and text[b - 1] == t[-1] for t, a, b in got)
    docs = spark.createDataFrame([(1, f"short\n{text}\nlast"), (2, None), (3, "")], "id long, text string")
    chunks = ig.pack(docs, "id", "text", 20).collect()
    assert [r["seq"] for r in chunks if r["id"] == 1] == list(range(len([r for r in chunks if r["id"] == 1]))) and not [r for r in chunks if r["id"] == 2]
    assert max(r["end"] - r["start"] for r in chunks) <= 21


def test_quotes_of_any_length_and_loose_ones(spark):
    docs = spark.createDataFrame([(1, "a big red dog"), (2, "x"), (3, "big  “red”\ndog – no"), (4, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "re"), (2, "big red"), (3, "x"), (4, "a big red dog"), (5, ""), (6, None), (7, "g")], "item_id long, quote string")
    got = sorted((r["item_id"], r["doc_id"], r["start"], r["end"]) for r in ig.locate(quotes, docs).collect())
    texts = {1: "a big red dog", 2: "x", 3: "big  “red”\ndog – no"}
    want = sorted((i, d, t.find(q), t.find(q) + len(q)) for i, q in [(1, "re"), (2, "big red"), (3, "x"), (4, "a big red dog"), (7, "g")] for d, t in texts.items() if q in t)
    assert got == want
    loose = spark.createDataFrame([(1, 'big "red" dog - no'), (2, '"red"'), (3, "big   red")], "item_id long, quote string")
    assert sorted((r["item_id"], r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in ig.locate_loosely(loose, docs).collect()) == [(1, 3, texts[3]), (2, 3, "“red”"), (3, 1, "big red")]


def test_finished_cases_as_they_come(spark, tmp_path):
    rows = [("a", True), ("a", False), ("b", True)]
    spark.createDataFrame(rows, "c string, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("c string, ok boolean").parquet(f"{tmp_path}/in")
    seen = []
    guards.finished_cases(stream, "c", "ok", 2).writeStream.outputMode("update").foreachBatch(lambda d, _: seen.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in seen] == [("a", 2, 1)]


def test_occurrences_are_whole_and_fold_marks(spark):
    docs = spark.createDataFrame([(1, "Read-only  mode, read‑only mode; unread-only mode"), (2, "It’s  Ann's read only mode"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("read-only mode",), ("it's",), ("--",), (None,)], "name string")
    got = sorted((r["name"], r["doc_id"], r["start"], r["end"]) for r in ig.occurrences(names, docs).collect())
    assert got == [("it's", 2, 0, 4), ("read-only mode", 1, 0, 15), ("read-only mode", 1, 17, 31)]


def test_names_are_found_where_texts_are_read(spark, monkeypatch):
    import random

    rng = random.Random(8)
    words = ["Ann", "b", "red", "x1", "it’s", "-", "a\u00a0 b", "\n\n", "é"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(30))) for i in range(40)} | {40: None, 41: "anna ann\tb annb ann  b"}
    names = ["ann b", "Red x1", "b", "it's red", "- b", "é", "", None, "b b"]
    fold = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower().translate(str.maketrans("’‐‑‒–—―\u00a0", "'------ ")))
    want = set()
    for i, t in texts.items():
        for name in filter(None, names):
            pattern = re.escape(fold(name).strip()).replace("\\ ", "[ \t\n\x0b\f\r\u00a0]+").replace("'", "['’]")
            at = 0
            while re.search("[a-z0-9]", fold(name)) and (m := re.compile(pattern, re.I).search(t or "", at)):
                at = m.end()
                if not re.match("[a-zA-Z0-9]", t[m.start() - 1 : m.start()]) and not re.match("[a-zA-Z0-9]", t[m.end() : m.end() + 1]):
                    want.add((name, i, m.start(), m.end()))
    tables = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (ig.NAME_BLOCK, 2):
        monkeypatch.setattr(ig, "NAME_BLOCK", block)
        found = ig.occurrences(*tables)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_embedded_text(spark):
    pages = ["<script>GLOBAL_CONFIG.larkContent = '<p>a \\\"b\\\" \\u4e2d\\/c</p>'; x</script><p>nav</p>", "GLOBAL_CONFIG.larkContent = 'open", "<p>plain</p>", None]
    assert values(spark, pages, ig.embedded_text) == ['<p>a "b" 中/c</p>', None, None, None]


def test_cases_are_validated_and_reports_written(spark, tmp_path):
    import json

    from docsight.sources import tables as tb

    good = {"case_id": "a", "question": "q", "criteria": [{"name": "c", "weight": 1.0}], "tags": ["x=1"]}
    for name, body in (("a.json", good), ("b.json", {"case_id": " ", "criteria": [{"name": "c", "weight": -1}], "enabled": False}), ("c.txt", good)):
        (tmp_path / name).write_text(json.dumps(body))
    got = {r["case_id"]: (r["enabled"], r["problems"]) for r in tb.read_cases(spark, str(tmp_path)).collect()}
    assert got == {"a": (True, []), " ": (False, ["negative weight", "no id", "no question"])}
    tb.write_report(tb.read_cases(spark, str(tmp_path)), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/json").count() == 2
    assert spark.read.option("header", True).csv(f"{tmp_path}/report/csv").filter("problems = '[]'").count() == 1


def test_upsert_subset_and_log(spark, tmp_path):
    from docsight.sources import tables as tb

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", True), (3, "d", None)], "id int, v string, w boolean")
    assert sorted((r["id"], r["v"], r["w"]) for r in ig.upsert(old, new, ["id"]).collect()) == [(1, "a", None), (2, "c", True), (3, "d", None)]
    rows = spark.createDataFrame([(["a"], ["b", "a"]), (["a", "a"], ["a"]), (["c"], ["a", "b"])], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(tx.is_proper_subset(F.col("x"), F.col("y"))).collect()] == [True, False, False]
    for _ in range(2):
        tb.append_log(old, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4


def test_windowed_counts_on_a_batch(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, event_type string")
    assert sorted(r["n"] for r in guards.windowed_counts(rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")).collect()) == [1, 2]


def test_many_articles_are_folded(spark):
    texts = [(1, "Cat sees " + "a " * 50000), (2, "The " * 50000 + "cat sees")]
    got = cp.health_marks(cp.propose_claims(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["marks"] for r in got} == {1: [], 2: []}
    assert values(spark, ["the a an The Cats"], fm.form_key) == ["cat"]
    assert values(spark, ["SO-that", "sothat", "an", "n", None], lambda x: tx.has_words(x, ("so that", "n"))) == [True, False, False, True, False]
