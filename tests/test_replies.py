"""Broken replies, sentences, name subsets, left-out neighbours, short quotes and bare pages."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsight.functions import forms as fm
from docsight.functions.replies import repair_json
from docsight.operators import cite
from docsight.operators import compile as cp
from docsight.operators import ingest as ig
from docsight.operators import judge as jd
from docsight.operators import retrieve as rt

REPLIES = [
    (None, None, []),
    ("no json", None, []),
    ('{"a": 1}', '{"a":1}', []),
    ('```JSON\n{"a": [1, 2,], }\n```', '{"a":[1,2]}', ["fence", "comma"]),
    ('Here: {"a": "x\ny\tz"} and {"b": 2}', '{"a":"x\\ny\\tz"}', ["before", "control", "after"]),
    ('[1, {"a": "}"}]', '[1,{"a":"}"}]', []),
    ('{"a": "b\\"c", "d": "e', '{"a":"b\\"c","d":"e"}', ["cut"]),
    ('{"a": 1, "b', '{"a":1}', ["cut"]),
    ('{"a": [1, {"b": 2}, {"c":', '{"a":[1,{"b":2},{}]}', ["cut"]),
    ('{"a": 1, "b": tru', '{"a":1}', ["cut"]),
    ('{"a": "x\\', '{"a":"x"}', ["cut"]),
    ('{"a": [1}', '{"a":[1]}', ["cut"]),
    ("{", "{}", ["cut"]),
]


@pytest.mark.parametrize("reply, want, repairs", REPLIES)
def test_repaired_replies(reply, want, repairs):
    got, found = repair_json(reply)
    assert got == want
    assert found == repairs


def test_sentence_bounds(spark):
    text = "  Dr. Smith paid 4.7 units, e.g. coins. He left!? It was 3 p.m. then…\nNo title\n\nfinal. Best"
    rows = cite.sentence_bounds(spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, text)], "doc_id long, text string")).collect()
    own = [r for r in sorted(rows) if r["doc_id"] == 1]
    assert [r["text"] for r in own] == ["Dr. Smith paid 4.7 units, e.g. coins.", "He left!?", "It was 3 p.m. then…", "No title", "final.", "Best"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in own) and [r["n"] for r in own] == list(range(6))
    assert {r["doc_id"] for r in rows} == {1, 4}


def test_name_subsets_equal_brute_force(spark):
    draw = random.Random(3)
    names = {f"n{i}": list({draw.choice("abcdefghij") for _ in range(draw.randrange(0, 5))}) for i in range(120)}
    df = spark.createDataFrame(list(names.items()), "id string, tokens array<string>")
    for most in (1, 2, 3):
        want = {(a, b) for a, x in names.items() for b, y in names.items() if 0 < len(x) <= most and set(x) < set(y)}
        got = [tuple(r) for r in cp.name_subsets(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_left_out_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5))
    labels = [None if i % 7 == 0 else i % 4 for i in range(59)] + [99]
    rows = [(i, labels[i], x[i].tolist()) for i in range(60)] + [(70, 1, None), (71, 1, [0.0] * 5)]
    got = {r["id"]: r for r in jd.nearest_left_out(spark.createDataFrame(rows, "id int, label int, v array<double>"), tile=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    assert set(got) == set(range(60))
    for i in range(60):
        own = [s[i, j] for j in range(60) if j != i and labels[j] == labels[i]]
        other = [s[i, j] for j in range(60) if labels[j] != labels[i]]
        assert got[i]["own"] == (pytest.approx(max(own), abs=1e-6) if own else None)
        assert got[i]["other"] == pytest.approx(max(other), abs=1e-6)
    assert jd.nearest_left_out(spark.createDataFrame([], "id int, label int, v array<double>")).count() == 0


def test_short_quotes_in_a_long_text(spark):
    text = "word 😀 " * 20_000
    docs = spark.createDataFrame([(1, text + "needle in hay"), (2, "x")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "needle"), (2, "😀 w"), (3, "zz"), (4, "x")], "item_id long, quote string")
    ig.locate(quotes, docs.limit(0)).count()
    began = time.time()
    got = sorted((r["item_id"], r["doc_id"], r["start"]) for r in ig.locate(quotes, docs).collect())
    assert got == [(1, 1, len(text)), (2, 1, 5), (4, 2, 0)]
    assert time.time() - began < 60


def test_pages_without_blocks():
    assert ig.html_sections("<body>Hello</body>") == [{"path": ig.INTRODUCTION, "paragraphs": ["Hello"]}]
    assert ig.html_sections("<main>one\n\n two <b>x</b></main>aside") == [{"path": ig.INTRODUCTION, "paragraphs": ["one", "two\nx"]}]
    assert ig.html_sections("<script>x</script>") == [] and ig.html_sections(None) == []
    assert ig.html_sections("<div>a box of some text</div>")[0]["paragraphs"] == ["a box of some text"]


def test_merged_entities(spark):
    rows = [
        (0, "Databases", "thing", ["DB"]), (1, "database", None, None), (2, "database", "store", ["db", " "]), (3, "database", "engine", []),
        (4, "The index", None, None), (5, "index", None, [None]), (6, "Indices", "b", None), (7, "indices", "a", None), (8, " ", "x", None), (9, None, "x", None), (10, "plain", None, None),
    ]
    df = spark.createDataFrame(rows, "place int, name string, type string, aliases array<string>")
    got = {r["key"]: tuple(r)[1:] for r in cp.merged_entities(df, "place").collect()}
    assert got["database"] == ("database", "store", ["DB", "Databases", "db"], 2, 4)
    assert got["index"][1] == "a" and set(got["index"][2]) | {got["index"][0]} == {"The index", "index", "Indices", "indices"}
    assert got["plain"] == ("plain", "concept", [], 1, 1)
    assert len(got) == 3 and cp.merged_entities(df.limit(0), "place").count() == 0


def test_values_of_undo_escapes(spark):
    rows = [('{"k": "a\\"b", "x": [{"k": "\\u00e9"}, {"k": 5}, {"other": "k"}]}',), ("{}",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(fm.values_of(F.col("j"), "k")).collect()]
    assert got == [['a"b', "é"], [], []]


def test_edge_audit(spark):
    plain = dict.fromkeys("object predicate_status predicate_normalized subject_status subject_resolved subject_concept subject_sources object_status object_resolved object_concept object_sources known_names".split())
    plain |= {"subject": "the red big dog", "predicate": "bites", "object": "a man in the park", "subject_concept": "red dog", "object_concept": "man"}
    cases = [
        ({}, ("edge", "", "red dog", "bites", "man")),
        ({"predicate_status": "pending", "subject": ""}, ("skipped", "predicate_pending", None, None, None)),
        ({"subject": None}, ("skipped", "no_subject", None, None, None)),
        ({"object": " "}, ("edge", "", "red dog", "bites", "")),
        ({"subject": "They"}, ("skipped", "subject_unusable", None, None, None)),
        ({"subject": "They", "subject_status": "resolved", "subject_resolved": "two dogs"}, ("edge", "", "two dogs", "bites", "man")),
        ({"object_status": "unresolved"}, ("skipped", "object_unusable", None, None, None)),
        ({"object_concept": " "}, ("skipped", "object_no_concept", None, None, None)),
        ({"object_concept": "when it rains"}, ("skipped", "object_clause", None, None, None)),
        ({"object_concept": "human being"}, ("skipped", "object_made_up", None, None, None)),
        ({"object_concept": "human being", "object_sources": ["park"]}, ("edge", "", "red dog", "bites", "human being")),
        ({"object_concept": "human being", "known_names": ["Human being."]}, ("edge", "", "red dog", "bites", "human being")),
        ({"object": "one more red-dog", "object_concept": "Red-dog"}, ("skipped", "same_ends", None, None, None)),
        ({"predicate": "was bitten by", "predicate_normalized": "bites"}, ("edge", "", "man", "bites", "red dog")),
    ]
    schema = "id int, subject string, object string, predicate string, predicate_status string, predicate_normalized string, known_names array<string>"
    schema += "".join(f", {e}_{c} {'array<string>' if c == 'sources' else 'string'}" for e in ("subject", "object") for c in ("status", "resolved", "concept", "sources"))
    names = [f.split()[0] for f in schema.split(", ")]
    rows = [tuple(({"id": i} | plain | c).get(n) for n in names) for i, (c, _) in enumerate(cases)]
    got = {r["id"]: r for r in cp.edge_audit(spark.createDataFrame(rows, schema), "id").collect()}
    for i, (case, want) in enumerate(cases):
        assert tuple(got[i][c] for c in ("status", "reason", "src", "predicate", "dst")) == want, case
    assert got[10]["dst_tier"] == "generalized" and got[13]["flipped"] and got[13]["surface"] == "was bitten by"


def test_gram_coverage_is_the_same_looked_up_and_joined(spark, monkeypatch):
    draw = random.Random(4)
    say = lambda n: "".join(draw.choices("ab😀 ", k=n))
    docs = [(i, say(draw.randrange(300))) for i in range(30)] + [(40, None), (41, "")]
    items = [(i, docs[i][1][5:60] + say(20)) for i in range(8)] + [(20, "short"), (21, None)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    held = {t[i : i + 6] for _, t in docs for i in range(len(t or "") - 5)}
    want = {i: round(len(g & held) / len(g), 4) for i, t in items if (g := {(t or "")[k : k + 6] for k in range(len(t or "") - 5)}) and len(t or "") >= 6}
    for bound in (rt.LOOKED_UP, 3):
        monkeypatch.setattr(rt, "LOOKED_UP", bound)
        assert {r["item_id"]: r["coverage"] for r in rt.gram_coverage(b, d, 6).collect()} == want


def test_no_vector_is_shuffled(spark):
    rows = [(i, i % 3, [float(i % 7) + 1, float(i % 5), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, label int, v array<float>")
    want = {}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, v in rows}
    for i, a, _ in rows:
        for same in (True, False):
            want[i, same] = round(max(sum(x * y for x, y in zip(unit[i], unit[j], strict=True)) for j, b, _ in rows if j != i and (a == b) == same), 6)
    got = jd.nearest_left_out(df, tile=50)
    assert {r["id"]: (r["own"], r["other"]) for r in got.collect()} == {i: (want[i, True], want[i, False]) for i in range(200)}
    # what is left to do joins two numbers a vector; pairs of tiles have been compared where the vectors were read
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
