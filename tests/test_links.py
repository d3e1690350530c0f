"""Naming, linking and judging on small, hand-written rows."""

from pyspark.sql import functions as F

from docsight.functions import naming as nm
from docsight.functions import text as tx
from docsight.operators import judge as jd
from docsight.operators import links as lk


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_name_tiers(spark):
    none = F.lit(None).cast("array<string>")
    tier = lambda n, r, d=none: value(spark, nm.name_tier(F.lit(n), F.lit(r), d))
    assert tier("the data stores", "a data store in use") == "ok"
    assert tier("auditability", "an auditable log") == "derived"
    assert tier("tooling", "tools, abstractions") == "derived"
    assert tier("guard", "limits and checks", F.array(F.lit("limits"), F.lit("checks"))) == "generalized"
    assert tier("guard", "limits and checks", F.array(F.lit("limits"), F.lit("fences"))) == "reject"
    assert tier(None, None) == "reject"


def test_bleeding_and_flipping(spark):
    assert value(spark, nm.bleeds(F.lit("allowlisted domain attack surface"), F.lit("an allowlisted domain"), F.lit("an attack surface")))
    assert not value(spark, nm.bleeds(F.lit("allowlisted domains"), F.lit("an allowlisted domain"), F.lit("a domain")))
    assert value(spark, nm.flips(F.lit("was written by"), F.lit("creates")))
    assert not value(spark, nm.flips(F.lit("was located by"), F.lit("located_in")))
    assert not value(spark, nm.flips(F.lit(None).cast("string"), F.lit(None).cast("string")))


def test_endpoint_plans(spark):
    plan = lambda raw, status, found: tuple(value(spark, nm.endpoint_plan(F.lit(raw).cast("string"), F.lit(status).cast("string"), F.lit(found).cast("string"))))
    assert plan("it", "resolved", "the agent") == ("resolved", "the agent")
    assert plan("it", "resolved", "a phrase of more than just six words") == ("normalize", "a phrase of more than just six words")
    assert plan("it", "unresolved", None) == ("unusable", "")
    assert plan("  ", None, None) == ("empty", "") and plan(None, None, None) == ("empty", "")
    assert plan("It", None, None) == ("unusable", "It")
    assert plan("the log", None, None) == ("normalize", "the log")


def test_lint_snap_and_hints(spark):
    s = lambda x: F.lit(x).cast("string")
    assert value(spark, nm.lint(s("does not quietly go away"), s("go"), s(None), s(None), s(None), ["go"])) == ["empty_object", "long", "negated"]
    assert value(spark, nm.lint(s("stops when"), s("stop"), s("it"), s(None), s(None), ["go"])) == ["clause", "off_vocabulary"]
    snap = lambda w: value(spark, nm.snap(s(w), ["run", "become", "carry", "place", "constrain"], {"limits": "constrain"}))
    assert [snap(w) for w in ("running", "Becomes", "carries", "placed", "limits", "flies", None)] == ["run", "become", "carry", "place", "constrain", None, None]
    assert value(spark, nm.appears(F.lit("Vector Store"), F.lit("stores of vectors: a vector in store"))) is True
    assert value(spark, nm.appears(F.lit("of a"), F.lit("nothing"))) is False
    assert tuple(value(spark, nm.bracket_parts(F.lit("Large Model (LM)")))) == ("Large Model", "LM")
    assert tuple(value(spark, nm.bracket_parts(F.lit("plain")))) == ("plain", None)
    assert value(spark, nm.is_risky(F.lit("Delete it now"), ["delete", "wipe"], ["how does"])) and not value(spark, nm.is_risky(F.lit("How does delete work"), ["delete"], ["how does"]))
    assert value(spark, nm.hints(F.lit("sum of 3 and 4, maybe"), {"calc": r"\bsum\b", "vague": "maybe", "date": "today"})) == ["calc", "vague"]


def test_roles_are_remapped(spark):
    df = spark.createDataFrame([(1, {"by": ["A", "z"], "at": []}), (2, None)], "k long, roles map<string,array<string>>")
    got = {r["k"]: r["roles"] for r in lk.remap_roles(df, "roles", {"A": "e1"}).collect()}
    assert got == {1: {"by": ["e1", "z"], "at": []}, 2: None}


def test_role_chunks_report_what_is_missing(spark):
    s = spark.createDataFrame([("limit", 1, ["c1", "c9"]), ("limit", 0, ["c2", "c1", "c3"]), ("none", 0, [])], "role string, claim_idx long, evidence array<string>")
    c = spark.createDataFrame([("c1", 5), ("c2", 50), ("c3", 4)], "chunk_id string, tokens long")
    got = {r["chunk_id"]: r["state"] for r in lk.role_chunks(s, c, 10).collect()}
    assert got == {"c1": "taken", "c2": "over_budget", "c3": "taken", "c9": "missing"}


def test_similar_blocks_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    lines = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(700)]
    text = "\n".join(["# head", "```", "abcabc", "```", *lines])
    got = {(r["a"], r["b"]): r["score"] for r in lk.similar_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string"), "k", "t").collect()}
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(x, i + 4)
    sets = [(p, {x[i : i + 2] for i in range(len(x) - 1)}) for x, p in first.items() if len(x) > 1]
    want = {(p, q): len(s & t) / len(s | t) for i, (p, s) in enumerate(sets) for q, t in sets[i + 1 :] if len(s & t) / len(s | t) >= 0.55}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.00005001 for k in want)


def test_repeated_headings(spark):
    df = spark.createDataFrame([(1, "# A\nx\n## A\n# B"), (2, None)], "k long, t string")
    assert [tuple(r) for r in lk.repeated_headings(df, "k", "t").collect()] == [(1, "A", 2)]


def test_closed_loop(spark):
    raw = spark.createDataFrame([("s", 0), ("s", 1), ("s", 2)], "source string, claim_idx long")
    kept = spark.createDataFrame(
        [("s", 0, "mapped", "go", "goes very far", "goes far", "q"), ("s", 1, "forced", "fly", "may go", "must go", ""), ("s", 7, "odd", None, "x", None, "q")],
        "source string, claim_idx long, status string, relation string, predicate string, clean string, anchor string",
    )
    entities = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "source string, name string")
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "a", "a"), ("s", "b", "d")], "source string, src string, dst string")
    statements = spark.createDataFrame(
        [("s", 0, ["c1"], "Limit", "far", ["goes very far"]), ("s", 1, [], "Limit", "near", ["far"]), ("s", 1, ["c1"], None, None, None)],
        "source string, claim_idx long, chunks array<string>, type string, type_evidence string, quotes array<string>",
    )
    got = {r["check"]: (r["ok"], r["bad"]) for r in lk.closed_loop(raw, kept, entities, edges, statements, ["go"]).collect()}
    assert got == {
        "status_complete": (False, 1), "relation_known": (False, 1), "clean_only_deletes": (False, 1), "anchored": (False, 1), "traceable": (False, 1),
        "ends_are_entities": (False, 2), "no_self_loops": (False, 1), "one_statement_each": (False, 2), "statements_anchored": (False, 1), "types_grounded": (False, 1),
    }


def test_attribution_stops_at_the_first_block(spark):
    rows = [("a", 0, "p", True, None), ("a", 1, "q", False, True), ("a", 2, "r", False, False), ("b", 0, "p", True, None), ("c", 0, "p", None, None), ("d", 0, "p", False, False)]
    got = jd.attribution(spark.createDataFrame(rows, "case string, pos long, point string, in_context boolean, in_corpus boolean"))
    assert {r["case"]: (r["state"], r["point"]) for r in got.collect()} == {"a": ("S2", "q"), "b": ("S1", None), "c": ("unknown", "p"), "d": ("S3", "p")}


def test_checklist_without_points(spark):
    points = spark.createDataFrame([("a", "ext", None, "covered")], "case string, kind string, grp string, value string")
    rules = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 0, True)], "case string, ext_min long, conditional boolean")
    assert {r["case"]: r["verdict"] for r in jd.checklist(points, rules).collect()} == {"a": "pass", "b": "fail", "c": "pass"}


def test_pieces_hold_every_gram(spark):
    text = "".join(chr(97 + i % 26) for i in range(100))
    got = value(spark, tx.pieces(F.lit(text), 32, 3))
    assert {p[i : i + 4] for p in got for i in range(len(p) - 3)} == {text[i : i + 4] for i in range(97)}


def test_case_axes(spark):
    rows = [(1, "x", ["lang=en", "new"], "One", True), (2, "x", ["lang=de"], "Two", None), (3, "y", None, "Three", False)]
    df = spark.createDataFrame(rows, "id long, category string, tags array<string>, title string, enabled boolean")
    ids = lambda **k: sorted(r["id"] for r in jd.select_cases(df, **k).collect())
    assert ids() == [1, 2] and ids(axes={"lang": "en"}) == [1] and ids(keyword="TW") == [2] and ids(categories=["y"]) == [] and ids(ids=[2, 3]) == [2]


def test_costs_are_rounded_as_the_product_says(spark):
    # the error is -54.949999999999996, ten times it -549.5
    runs = spark.createDataFrame([(900.0, 9, 0, 9, 18000.0), (10.0, 1, 0, None, 8.0)], "unit double, rated int, kept int, reduce int, actual double")
    assert [(r["predicted"], r["error_pct"]) for r in jd.cost_model(runs).orderBy("actual").collect()] == [(10, 25.0), (8109, -55.0)]
    assert value(spark, tx.rounded(F.lit(None).cast("double"), 1)) is None


def test_overlaps_equal_every_trial(spark):
    import random

    rng = random.Random(3)
    texts = ["ab" * 20, "ab" * 15 + "x", "é" * 30, "é" * 25, "", "a" * 11, "a" * 12, None, "a" * 500]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [t[-rng.randrange(1, 40) :] + "tail" for t in texts if t]
    rng.shuffle(texts)
    for least, most in ((12, 400), (3, 20)):
        got = {r["seq"]: r["overlap"] for r in lk.adjacent_overlap(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, seq int, x string"), "g", "seq", "x", least, most).collect()}
        fits = lambda a, b: max([k for k in range(least, most + 1) if k <= min(len(a), len(b or "")) and a[-k:] == b[:k]], default=0)  # noqa: E731, B023
        assert got == {i: fits(texts[i - 1], texts[i]) for i in range(1, len(texts)) if texts[i - 1] is not None}
    plan = lk.adjacent_overlap(spark.createDataFrame([], "g int, seq int, x string"), "g", "seq", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # no trial of every length for every pair
