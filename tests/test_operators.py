"""Behaviour of the engine's own operators on small, hand-written rows."""

from pyspark.sql import functions as F

from docsight import catalog
from docsight.functions import forms as fm
from docsight.functions import text as tx
from docsight.operators import compile as cp
from docsight.operators import evaluate as ev
from docsight.operators import graph as gr
from docsight.operators import ingest as ig
from docsight.operators import retrieve as rt
from docsight.streaming import guards


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_forms(spark):
    assert value(spark, tx.long_tokens(F.lit("A b-c v1.2 x Hello_World"))) == ["b-c", "v1.2", "hello_world"]
    assert value(spark, fm.form_key(F.lit("The  Data-Stores"))) == "data store"
    assert value(spark, fm.form_key(F.lit("Policies"))) == "policy"
    assert value(spark, tx.is_acronym_of(F.lit("RRF"), F.lit("reciprocal rank fusion")))
    assert value(spark, tx.normalized(F.lit("‘a’ – b"))) == "'a' - b"


def test_subsequence(spark):
    words = lambda s: F.array(*map(F.lit, s.split()))
    assert value(spark, tx.is_subsequence(words("a c"), words("a b c")))
    assert not value(spark, tx.is_subsequence(words("c a"), words("a b c")))


def test_guarded_replies(spark):
    got = value(spark, tx.tolerant_json(F.lit('```json\n{"a": 1, "b": [1, 2,],}\n```'), "a int, b array<int>"))
    assert (got["a"], got["b"]) == (1, [1, 2])
    assert value(spark, tx.contained(F.lit("bc"), F.array(F.lit("abcd"))))
    assert not value(spark, tx.contained(F.lit("x"), F.array(F.lit("abcd"))))


def test_html_and_markdown_sections():
    html = "<nav>no</nav><h1>A</h1><p>one<p>two <b>bold</b><h2>B</h2><ul><li>x</li></ul><script>no()</script>"
    assert ig.html_sections(html) == [{"path": "A", "paragraphs": ["one", "two bold"]}, {"path": "A / B", "paragraphs": ["x"]}]
    assert ig.markdown_sections("---\nt: 1\n---\n# A {#id}\ntext\n### C\n![i](x)\nmore") == [
        {"path": "A", "paragraphs": ["text"]},
        {"path": "A / C", "paragraphs": ["more"]},
    ]
    assert ig.html_sections(None) == []


def test_chunks_cover_the_text(spark):
    text = "aa\nbbbb\n" + "c" * 30 + "\n\ndd"
    rows = ig.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", 10).orderBy("seq").collect()
    assert [text[r["start"] : r["end"]] for r in rows] == ["aa\nbbbb", "c" * 10, "c" * 10, "c" * 10, "\ndd"]
    assert [r["n"] for r in rows] == [2, 1, 1, 1, 2]


def test_budgets(spark):
    hits = spark.createDataFrame([(1, 1, 90), (1, 2, 20), (1, 3, 10), (2, 1, 500)], "g int, o long, t long")
    stop = {(r["g"], r["o"]) for r in rt.budget_stop(hits, "g", ["o"], "t", 100).collect()}
    assert stop == {(1, 1), (2, 1)}
    skip = {r["g"]: r["ids"] for r in rt.budget_skip(hits, "g", "o", "t", 100).collect()}
    assert skip == {1: [1, 3], 2: []}


def test_fusion_keeps_lexical_only_hits(spark):
    dense = spark.createDataFrame([(0, 7, 1, 0.9)], "query_id long, id long, rank int, dense double")
    lex = spark.createDataFrame([(0, 8, 1, 3.0)], "query_id long, id long, rank int, bm25 double")
    got = {r["id"]: (r["rrf"], r["dense"]) for r in rt.rrf(dense, lex).collect()}
    assert got == {7: (0.016393, 0.9), 8: (0.016393, None)}


def test_lexical_scores_equal_a_plain_loop_and_shuffle_no_postings(spark, monkeypatch):
    import math
    import random

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(rng.randrange(9)))) for i in range(90)] + [(90, None), (91, "zz" * 4000)]
    asked = [(q, " ".join(rng.choice("aa bb cc dd zz yy".split()) for _ in range(4))) for q in range(7)] + [(7, None)]
    words = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, words.values())) / (len(docs) - 1)
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    raw = {w: math.log((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    want = {}
    for q, text in asked:
        scores = {}
        for i, x in words.items():
            for w in (text or "").split():
                if w in x:
                    tf = x.count(w)
                    scores[i] = scores.get(i, 0) + (raw[w] if raw[w] >= 0 else low) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / mean))
        best = sorted(((-round(s, 4), i) for i, s in scores.items() if round(s, 4) > 0))[:5]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    tables = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "id long, text string").repartition(3)
    for block in (rt.QUERY_BLOCK, 2):
        monkeypatch.setattr(rt, "QUERY_BLOCK", block)
        hits = rt.bm25_top_k(*tables, tx.long_tokens, 5)
        assert {(r["query_id"], r["rank"]): (r["id"], r["bm25"]) for r in hits.collect()} == want
        assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_equals_brute_force(spark):
    spans = [(1, i, i * 7, i * 7 + 5 + i) for i in range(20)]
    chunks = [(1, j, j * 11, j * 11 + 11) for j in range(15)]
    got = {(r["span"], r["seq"]) for r in cp.overlap(spark.createDataFrame(spans, "doc_id long, span long, lo long, hi long"), spark.createDataFrame(chunks, "doc_id long, seq long, start long, end long"), 8).collect()}
    assert got == {(s[1], c[1]) for s in spans for c in chunks if c[2] < s[3] and c[3] > s[2]}


def test_every_claim_gets_an_edge_or_a_reason(spark):
    docs = spark.createDataFrame([(1, "Parsers read files. It was a cat. Cats like cats"), (2, None)], "doc_id long, text string")
    rows = cp.assemble(cp.propose_claims(docs)).collect()
    assert len(rows) == 3 and all((r["skipped"] is None) == (r["src"] is not None) for r in rows)
    assert {r["skipped"] for r in rows} == {None, "subject_pronoun", "self_loop"}


def test_components_and_degree(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (2, 1), (5, 5)], "src long, dst long")
    assert {r["node"]: r["component"] for r in gr.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 8: 8, 9: 8}
    assert {r["node"]: r["degree"] for r in gr.undirected_degree(e).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 8: 1, 9: 1}


def test_similar_names_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 8))]) for i in range(150)] + [(150, None), (151, ["a", None, "b"]), (152, [None])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    for least in (0.8, 0.5, 0.2):
        want = {}
        for a, x in rows:
            for b, y in rows:
                x_, y_ = set(x or []) - {None}, set(y or []) - {None}
                if a < b and x_ and y_ and len(x_ & y_) / len(x_ | y_) >= least:
                    want[a, b] = round(len(x_ & y_) / len(x_ | y_), 4)
        got = cp.name_pairs(df, least).collect()
        assert {(r["a"], r["b"]): r["score"] for r in got} == want and len(got) == len(want)
    # a token that all have joins nothing by itself: each set is joined on two of its tokens
    wide = spark.range(3000).select("id", F.array(F.lit("all"), F.lit("day"), F.concat(F.lit("c"), F.col("id"))).alias("tokens"))
    assert cp.name_pairs(wide, 0.8).count() == 0


def test_long_chains_leave_no_estimates_behind(spark):
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = gr.components(chain)
    assert found.count() == 3001 and found.agg(F.max("component")).first()[0] == 0
    # the planner's guess of the size is a product over all rounds, unless the rounds' tables hide where they come from
    guess = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert guess < 1 << 512


def test_level_selection_by_threshold(spark):
    rows = [(0, None, 0, 5), (1, None, 0, 1), (2, 0, 1, 4), (3, 0, 1, 1), (4, 1, 1, 5), (5, 2, 2, 3), (6, 4, 2, None)]
    got = gr.select_levels(spark.createDataFrame(rows, "community long, parent long, level int, rating int"), [3, 5, 6]).collect()
    # at 3: 0 opens 2, 2 opens 5; at 5: 0 alone, for 4 hangs below 1, which was not selected; at 6: nothing
    assert {(r["threshold"], r["community"]) for r in got if r["kept"]} == {(3.0, 5), (5.0, 0)}
    assert {(r["threshold"], r["community"]) for r in got} == {(3.0, 0), (3.0, 2), (3.0, 5), (5.0, 0)}
    low = [(0, None, 0, 1), (1, 0, 1, 4), (2, 0, 1, 1), (3, 1, 2, 4)]
    got = gr.select_levels(spark.createDataFrame(low, "community long, parent long, level int, rating int"), [4])
    # no root reaches 4, so the next level opens whole
    assert sorted(r["community"] for r in got.filter("kept").collect()) == [3]


def test_budgets_equal_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(g, i, rng.choice([1, 2, 3, 5, 8, 13, 40])) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, i long, n long").repartition(5)
    for cap in (1, 17, 39, 100):
        skip, stop = {}, {}
        for g in range(3):
            used, skip[g] = 0, []
            for _, i, n in (r for r in rows if r[0] == g):
                if used + n <= cap:
                    used += n
                    skip[g].append(i)
            used, stop[g] = 0, []
            for _, i, n in (r for r in rows if r[0] == g):
                if used + n > cap and stop[g]:
                    break
                used += n
                stop[g].append(i)
        assert {r["g"]: list(r["ids"]) for r in rt.budget_skip(df, "g", "i", "n", cap).collect()} == skip
        got = {}
        for r in rt.budget_stop(df, "g", ["i"], "n", cap).collect():
            got.setdefault(r["g"], []).append(r["i"])
        assert {g: sorted(x) for g, x in got.items()} == stop


def test_verdicts(spark):
    rows = [("a", True, False), ("a", False, False), ("b", None, False), ("c", None, True), ("d", True, False)]
    got = ev.roll_up(spark.createDataFrame(rows, "case string, ok boolean, error boolean"), "case")
    assert {r["case"]: r["verdict"] for r in got.collect()} == {"a": "unstable", "b": "pending", "c": "exec_error", "d": "pass"}


def test_leak_over_two_deltas(spark):
    d = spark.createDataFrame([(1, 0, "abc se"), (1, 1, "cret x"), (2, 0, "fine")], "k long, o long, t string")
    assert [(r["k"], r["cut"]) for r in guards.first_leak(d, "k", "o", "t", ["secret"]).collect()] == [(1, 4)]


def test_coverage_searches_documents_without_labels(spark):
    tables = {
        "benchmark": spark.createDataFrame([(1, "a passage of some length"), (2, "nowhere to be found")], "item_id long, text string"),
        "documents": spark.createDataFrame([(1, "labelled"), (2, "here is a passage of some length, unlabelled")], "doc_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"),
    }
    got = catalog.ngram_coverage_all(tables.get).collect()
    assert {r.item_id: r.coverage for r in got} == {1: 1.0, 2: 0.0}
