"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from docsight.llm import chat, hnsw, langid, lm_score, mixing, quality, sharding, simhash, url_filter
from docsight.llm import sentencepiece_scan as sp
from docsight.llm.components import connected_components
from docsight.llm.queries import op5_simhash, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, `__x` int"
ODD = [
    (1, None, "en", "a", 0, "s", "x", 1),
    (2, "", None, None, None, None, None, None),
    (None, "the cat and the dog " * 30, "en", "a", 0, "s", "x", 1),
    (3, "the cat and the dog " * 30, "en", "b", 0, "s", "x", 1),
    (3, "the cat and the dog " * 30, "en", "b", 0, "s", "x", 1),
    (4, "der Hund und die Katze öü " * 2000, "de", "b", 0, "s", "x", 1),
    (5, "x" * 40_000, "de", "b", 0, "s", "x", 1),
    (6, "123 456 -- !!", "de", "c", 0, "s", "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


def test_feistel_is_a_permutation_with_an_inverse():
    for n in (1, 2, 7, 64, 1000, 4097):
        at = sharding.permute(np.arange(n), n, 5)
        assert sorted(at) == list(range(n))
        assert (sharding.unpermute(at, n, 5) == np.arange(n)).all()


def test_shards_are_even_and_slots_gapless(spark, odd):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == len(ODD)
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert all(sharding.row_at(r["shard"], r["slot"], len(ODD), 3, 2024) == r["row_number"] for r in rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in ODD)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(odd.repartition(5), 3).collect()))
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_language_on_odd_rows(spark, odd):
    rows = langid.predict_documents(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 6))
    assert langid.predict_documents(odd.limit(0)).count() == 0
    assert langid.known_language(odd).columns == odd.columns
    assert not any(map(langid.has_letter, ["²½", "Ⅷ ①", "123 _", ""])) and langid.has_letter("² x") and langid.has_letter("漢")


def test_language_is_right_on_held_out_documents(spark):
    draw = random.Random(4)
    kinds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["schl", "acht", "ung", "ö"], "zz": ["eau", "oui", "é", "que"]}
    rows = [(i, " ".join("".join(draw.choices(kinds[k], k=3)) for _ in range(20)), k) for i in range(400) for k in [draw.choice(list(kinds))]]
    rows += [(i, "²½ 12", "xx") for i in range(400, 410)] + [(500, "kato miru", "xx")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict_documents(docs).collect()
    truth = {i: (k if langid.has_letter(t) else "und") for i, t, k in rows}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    other = langid.predict_documents(docs.repartition(5)).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in got} == {(r["doc_id"], r["lang_pred"]) for r in other}


def test_scan_equals_the_library():
    path = tokenizer_path()
    own = sp.Codec(path)
    random.seed(3)
    for _ in range(12):
        text = "".join(random.choice(["the ", "ing", " ", "  ", "é", "漢", "😀", "\n", "word ", "tion"]) for _ in range(120))
        whole, chunk, states = sp.marked(text), 37, []
        for a in range(0, len(whole), chunk):
            b, at = min(len(whole), a + chunk), max(0, a - 48)
            part = whole[at : b + 1]
            m = sp.transfer(own.model, part, a - at, b - at)
            states.append((at, part, a - at, b - at, {((e[0] + at, e[1]), (x[0] + at, x[1])): w for (e, x), w in m.items()}))
        found, ids = sp.solve([s[-1] for s in states], len(whole)), []
        for (e, x), (at, part, a, b, _) in zip(found, states, strict=True):
            ids += sp.trace(own.model, part, (e[0] - at, e[1]), (x[0] - at, x[1]), a, b, own.walked)
        assert ids == own.library.encode(text) == own.encode(text)
        assert own.decode(ids) == text


def test_unigram_scan_equals_viterbi():
    model = sp.Pieces({"a": (0, -1.0), "b": (1, -1.2), "ab": (2, -1.9), "ba": (3, -1.5), "aba": (4, -3.1), "bb": (5, -2.9)}, None, 9, False)
    random.seed(5)
    for _ in range(20):
        text = "".join(random.choice("ab") for _ in range(30))
        best = [0.0] + [-1e9] * len(text)
        for i in range(len(text)):
            for e in model.ends(text, i):
                best[e] = max(best[e], best[i] + model.pieces.get(text[i:e], (0, model.low))[1])
        whole = sp.combine(sp.transfer(model, text, 0, 11), sp.combine(sp.transfer(model, text, 11, 20), sp.transfer(model, text, 20, 30)))
        assert max(w for (e, x), w in whole.items() if x[0] == 30) == pytest.approx(best[-1])


def test_encode_odd_rows(spark, odd):
    rows = sp.encode(odd, tokenizer_path(), ["doc_id", "size"]).collect()
    own = sp.Codec(tokenizer_path())
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    texts = {r[0]: r[1] for r in ODD}
    assert sp.encode(odd.limit(0), tokenizer_path(), ["doc_id"]).count() == 0
    assert all(r["ids"] == (None if texts[r["doc_id"]] is None else own.library.encode(texts[r["doc_id"]])) for r in rows)


def test_url_lists_as_of(spark):
    caps = spark.createDataFrame([("http://A.b.com/x/y?q", "2020-01-05"), ("http://a.b.com/x", "2020-01-20"), (None, "2020-01-05"), ("nonsense", None)], "url string, day string")
    entries = spark.createDataFrame(
        [("l", "d:b.com", "2020-01-01", "add"), ("l", "d:b.com", "2020-01-10", "remove"), ("m", "p:a.b.com/x", "2020-01-06", "add"), ("m", None, "2020-01-06", "add")],
        "list_id string, key string, day string, action string",
    )
    got = {(r["url"], str(r["day"])): r["lists"] for r in url_filter.evaluate(caps, entries).collect()}
    assert got == {("http://A.b.com/x/y?q", "2020-01-05"): ["l"], ("http://a.b.com/x", "2020-01-20"): ["m"], (None, "2020-01-05"): [], ("nonsense", "None"): []}


def test_fingerprint_by_hand():
    text = b"One two THREE four five one two three four"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(b"a b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_trie_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)]))
    pairs = {(i, j) for a, b in simhash.trie_pairs(codes, 0, 4) for i, j in zip(a, b, strict=True)}
    near = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert {(min(p), max(p)) for p in pairs} == near
    got = {r["print"]: r["head"] for r in simhash.classes(spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "print long")).collect()}
    signed = codes.view(np.int64)
    assert all((got[signed[i]] == got[signed[j]]) for i, j in near)
    assert len(set(got.values())) == len(codes) - len({(i, j) for i, j in _forest(near)})


def test_simhash_links_are_the_same_for_any_number_of_leading_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [base.copy() for _ in range(6)]
    for copy in flips:
        for _ in range(3):
            copy ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
    codes = np.unique(np.concatenate([base, *flips]))
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)] + [(None,)], "print long")
    found = []
    for leading in (1, 2, 3, 4):
        monkeypatch.setattr(simhash, "TILE", 64 if leading == 2 else 2048)
        parts = connected_components(simhash.near_links(frame, 4, leading)).collect()
        found.append({r["node"]: r["component"] for r in parts})
    assert found[0] and all(f == found[0] for f in found)
    near = {(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert len(found[0]) - len(set(found[0].values())) == len(list(_forest(near)))


def test_simhash_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "a b c d e", "x"), (3, None, "x"), (2, "", None), (4, " \n", None)]
    for i in range(10, 60):
        own = draw.choices(words, k=150)
        rows += [(10 * i, " ".join(own), "x"), (10 * i + 1, " ".join(own).upper(), "y"), (10 * i + 2, " ".join([*own[:75], "new", *own[76:]]), "z")]
    spark.createDataFrame(rows, "doc_id long, text string, head string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op5_simhash(spark, str(tmp_path)).collect()}
    prints = [(i, simhash.fingerprint((t or "").encode(), 4)) for i, t, _ in rows]
    head = list(range(len(prints)))
    for i, j in ((i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 4):
        a, b = sorted((head[i], head[j]))
        head = [a if x == b else x for x in head]
    least = {h: min((prints[i][0] for i in range(len(head)) if head[i] == h and prints[i][0] is not None), default=None) for h in set(head)}
    assert got == {(i, f"{p:016x}", least[h]) for (i, p), h in zip(prints, head)}


def _forest(pairs):
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            yield i, j


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def _lm_docs(spark, n=240):
    """Documents over a skewed vocabulary in two languages, odd rows among them."""
    draw = random.Random(9)
    common, foreign = [f"w{i}" for i in range(40)], [f"ö{i}é" for i in range(40)]
    rows = [(i, " ".join(draw.choice(foreign if i % 4 == 0 else common) if draw.random() < 0.8 else f"Rare{draw.randrange(600)}" for _ in range(draw.randrange(1, 60)))) for i in range(n)]
    rows += [(900, None), (901, ""), (None, "w1 W2"), (902, " ".join(draw.choices(common, k=30_000))), (902, "w1 " * 20), (903, "\x01\x02 \x00")]
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, word int, kind string, n int").repartition(3), rows


def test_lm_base_equals_brute_force_and_the_model_beats_it(spark):
    docs, rows = _lm_docs(spark)
    words = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    seen = Counter(w for own, o in zip(words, out) if not o for w in own)
    total, distinct = sum(seen.values()), len(seen)
    want = sorted(
        (str(i), o, len(own), sum(seen[w] > 0 for w in own), total, round(sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), 6))
        for (i, _), own, o in zip(rows, words, out)
    )
    got = lm_score.score_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def test_lm_beats_the_base_on_held_out_documents(spark):
    rows = [r for r in lm_score.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / tokens > sum(r["base_score"] for r in rows) / tokens + 0.3
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.6 * len(rows)


def test_lm_followers_are_a_distribution():
    """What a gate leaves to spelling and what it gives to followers is 1 at most, and pairs are counted across texts' starts."""
    keys = lm_score.pair_keys(np.array([3, 5, -1, 3, 0]))
    assert keys.tolist() == [3, 3 << 32 | 5, -1, -1, 3 << 32]
    counts = np.array([7, 0, 0, 9, 0, 4])
    keys, n = np.array([3, 3 << 32, 3 << 32 | 5, 5 << 32 | 3]), np.array([7, 2, 6, 4])
    share, rest = lm_score.trust(keys, n, counts, 20)
    for word in (0, 3, 5):
        assert share[keys >> 32 == word].sum() + rest[word] <= 1 + 1e-12
    assert rest[[1, 2, 4]].tolist() == [1, 1, 1]


def test_lm_mixers_learn_from_all_training_words(spark, monkeypatch):
    """More words and contexts than the samples held that the mixers learned from before."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeü", k=draw.randrange(2, 12))) for _ in range(40_000)] + ["often"] * 5000
    docs = spark.createDataFrame([(i, " ".join(words[i::300])) for i in range(300)], "doc_id long, text string").repartition(3)
    counted = lm_score.cut(lm_score.pack_words(lm_score.count_words(docs, 2))).filter("kind >= 0")
    about, sc = counted.drop("payload").collect(), spark.sparkContext
    over, shared = lm_score.overlaps(about), lm_score._shared_counts(counted, sc.broadcast(lm_score.overlaps(about)))
    slots = lm_score._bit_counts(counted, sum(r["distinct"] for r in about), 16)
    mixer = lm_score._train_mixer(counted, sc.broadcast(slots), 16, sc.broadcast(over), sc.broadcast(shared))
    train = [w for i in range(300) if zlib.crc32(str(i).encode()) % 10 for w in words[i::300]]
    assert (mixer.seen - lm_score.Mixer.fresh().seen).sum() == pytest.approx(8 * sum(len(w.encode()) for w in train), rel=1e-6)

    held, events = [], lm_score.FirstBytes._events
    monkeypatch.setattr(lm_score.FirstBytes, "_events", lambda self, upto: held.append(len(upto[0])) or events(self, upto))
    contexts = np.arange(3000) << 2
    lm_score.FirstBytes(contexts << 8 | 97, np.full(len(contexts), 3), 2)
    assert sum(held) == len(contexts)


def test_lm_texts_together_equal_texts_alone():
    texts = [b"a bb  ccc\n", b"", b" \x00 x", "dd\x0bé".encode(), b"one"]
    context, first, starts = lm_score.seams(texts, [0, 1, 2, 3, 15], 3)
    alone = [lm_score.seams([t], [k], 3) for t, k in zip(texts, [0, 1, 2, 3, 15])]
    assert context.tolist() == np.concatenate([a[0] for a in alone]).tolist() and first.tolist() == np.concatenate([a[1] for a in alone]).tolist()
    assert np.diff(starts, append=len(first)).tolist() == [len(t.split()) + 1 for t in texts]
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 5000))
    asked = np.concatenate([keys[::3], keys[::7] + 1, [-1]])
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert lm_score.key_places(lm_score.key_slots(keys), keys, asked).tolist() == [place.get(k, -1) for k in asked.tolist()]
    assert lm_score.key_places(lm_score.key_slots(keys[:0]), keys[:0], asked).max() == -1


def test_lm_runs_where_workers_lack_the_package(tmp_path):
    """A run from another folder, with the package on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from docsight.llm import lm_score
docs = spark.createDataFrame([(i, "one two three four") for i in range(40)], "doc_id long, text string")
def lacks(_): 
    import importlib.util
    yield importlib.util.find_spec("docsight") is None
print("lacks", all(spark.sparkContext.parallelize([0]).mapPartitions(lacks).collect()), "rows", lm_score.score_documents(docs).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "lacks True rows 40" in done.stdout, done.stderr[-2000:]


def test_lm_order_of_words_counts_and_blocks_do_not(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{draw.randrange(9)}{'.,'[k % 2]}" for k in range(40))) for i in range(200)]
    rows += [(1000, " ".join(["a1.", "b2,"] * 20)), (1001, " ".join(["a1."] * 20 + ["b2,"] * 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    score = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs).collect()}
    assert score[1000] > score[1001] + 1
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 7)
    again = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs).collect()}
    assert again == pytest.approx(score, rel=1e-4)


def test_lm_costs_are_a_distribution():
    alphabet, longest = [b"a", b"b", b"\x01"], 3
    words = sorted(lm_score.spell(b"".join(w)) for n in range(1, longest + 1) for w in itertools.product(alphabet, repeat=n))
    trained = np.array([i % 5 * 3 for i in range(len(words))])
    bits = 16
    counts = lm_score.pack(*np.random.default_rng(1).integers(0, 40, (2, len(lm_score.ORDERS) << bits)))
    model = lm_score.Model(counts, bits, lm_score.Mixer.fresh())
    e = lm_score.expand(words)
    cost = model.cost(e, trained, {})
    # of all continuations of a first byte those seen here make a part only
    for first in alphabet:
        assert 0 < sum(10**c for c, w in zip(cost, words) if w[:1] == first) < 1
    sofar = lm_score.beginnings(e, trained, {})
    for j, at in enumerate(e.at):
        own = words[e.owner[at]]
        before, value = own[: e.depth[j]], e.value[j]
        for place in range(8):
            same = [(w[e.depth[j]], n) for w, n in zip(words, trained) if w.startswith(before) and w[e.depth[j]] >> (8 - place) == value >> (8 - place)]
            assert [sum(n for v, n in same if (v >> (7 - place)) & 1 == bit) for bit in (0, 1)] == list(sofar[:, place, j])
    slots = lm_score.bit_slots(e.value, e.contexts, bits)
    assert slots.min() >= 0 and all((slots[:, i] >> bits == i).all() for i in range(len(lm_score.ORDERS)))
    keys = np.sort(np.random.default_rng(2).integers(0, 4 << (16 + 2), 5000))
    table = lm_score.FirstBytes(keys, np.full(len(keys), 50), 2).table
    assert np.allclose((10.0**table).sum(axis=1), 1, atol=1e-3)


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[200:260] = x[:60] + 0.05 * rng.standard_normal((60, 16))
    x[260:300] = x[0]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1)]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    found = sum(got[i]["n_links"] for i in range(300))
    assert 0.9 * (near.sum() - 300) <= found <= near.sum() - 300
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 904))
    assert got[299]["component_id"] == 0 and not got[299]["kept"]
    links = [(i, j) for i, j in zip(*np.nonzero(near)) if i != j]
    assert all(got[i]["n_links"] > 0 and got[j]["n_links"] > 0 for i, j in links)
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_shard_counts_links_from_either_end():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 12))
    x = centres[rng.integers(0, 40, 1500)] + 0.16 * rng.standard_normal((1500, 12))
    shard = hnsw.Shard(np.arange(1500), rng.integers(1, 4, 1500), x, 0.9)
    shard.beam = 2  # so narrow that searches from two ends differ
    found = [(i, j) for a, b in shard.links(shard.unit) for i, j in zip(a.tolist(), b.tolist()) if i != j]
    either = set(found) | {p[::-1] for p in found}
    one_way = either - set(found)
    count, labels = shard.own_links()
    assert one_way
    want = np.zeros(1500, dtype=np.int64)
    for i, j in either:
        want[i] += shard.weights[j]
    assert (count == want).all()
    assert all(labels[i] == labels[j] for i, j in either)


def test_near_vectors_row_by_row(spark):
    """Every row's links and class against brute force; cosines of exactly the threshold link."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 6))
    x[60:] = x[:60] + 0.2 * rng.standard_normal((60, 6))
    x[:4] = [[3, 4, 0, 0, 0, 0], [4, 3, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 3, 4, 0, 0]]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.einsum("ik,jk->ij", u, u) >= 0.96
    near[0, 1] = near[1, 0] = True  # 24 / 25, in whole numbers
    np.fill_diagonal(near, False)
    parts = list(range(120))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = parts[i], parts[j]
        parts = [min(a, b) if p in (a, b) else p for p in parts]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), threshold=0.96 - 1e-12).collect()}
    assert [got[i]["n_links"] for i in range(120)] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(120)] == parts


def test_vectors_without_ids_name_no_class(spark):
    x = np.eye(8)
    close = lambda i, by: (x[i] + by * x[(i + 1) % 8]).tolist()
    rows = [(5, close(0, 0.0), "a"), (6, close(0, 0.1), "b"), (None, close(0, 0.2), None), (None, close(0, 0.2), None), (None, close(4, 0.0), None), (9, close(2, 0), "c"), (9, close(2, 0), "c")]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 3, 5, True), (6, 3, 5, False), (None, 3, None, False), (None, 3, None, False), (None, 0, None, False), (9, 1, 9, True), (9, 1, 9, True)], key=str)


def _filled(sizes, ceiling=3):
    """Targets by hand: the excess of capped sources shared again by weight."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    out, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > ceiling * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: float(ceiling * sizes[s]) for s in over}
        open_ -= set(over)
        left = float(sum(sizes.values())) - sum(out.values())
    return out


def test_targets_equal_filling_by_hand(spark):
    draw = random.Random(5)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}": draw.choice([0, 1, 5, 100, 3000]) for i in range(n)} | {None: 90, "é": 3, "": 8}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)).collect()}
        assert got == pytest.approx(_filled(sizes))
    assert mixing.targets(spark.createDataFrame([], "source string, size long")).count() == 0


def test_mix_takes_near_the_target_and_reruns_agree(spark, odd, monkeypatch):
    draw = random.Random(6)
    rows = [(i, " ".join("w" * draw.randrange(1, 30)) if i % 9 else None, draw.choice(["a", "b", "c", None])) for i in range(600)]
    rows += [(7, "x y z", "d")] * 500 + [(8, "one two", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, most = _filled(sizes), Counter(), Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes if want[s] < 3 * sizes[s] or s == "d")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(2)).collect()))
    assert len(mixing.mix_documents(odd).collect()) == len(ODD) and mixing.mix_documents(odd.limit(0)).count() == 0


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] <\\s> [\\\\INST] \\ [ROLE x] <|image:0|>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, said + " "), (2, None, "tool", None), (2, 0, "assistant", "")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.parse(out[1]["formatted"]) == [("user", said), ("assistant", said), (None, said + " ")]
    assert chat.parse(out[2]["formatted"]) == [("tool", ""), ("assistant", "")]
    s = out[1]["loss_spans"][0]
    assert chat.unescape(out[1]["formatted"][s["start"] : s["end"]]) == said
    got = chat.render([("user", [{"type": "image", "uri": "u", "width": 56, "height": 29}, {"text": "a"}, {"type": "audio", "seconds": 2.0}])])
    assert got["formatted"] == "<s>[INST] <|image:0|>a<|audio:1|> [/INST]" and [a["tokens"] for a in got["attachments"]] == [4, 50]


def test_chat_control_strings_across_parts_stay_text():
    said = [["hi <", "/s>"], ["ok<", "/s>[INST", "] evil"], ["<", "s", ">"], ["<|image:", "0|>", None], ["[", "/INST", "]<\\", "/s>"]]
    for parts in said:
        for role in ("user", "assistant", "tool", None):
            typed = [{"type": "text", "text": p} for p in parts]
            out = chat.render([(role, typed), ("user", [{"text": "<"}, {"type": "image", "uri": "u"}, {"text": "s>"}])])
            assert chat.parse(out["formatted"]) == [(role, "".join(p or "" for p in parts)), ("user", "<<|image:0|>s>")]
            if role == "assistant":
                s = out["loss_spans"][0]
                assert chat.unescape(out["formatted"][s["start"] : s["end"]]) == "".join(p or "" for p in parts)


def test_chat_digest_equals_hashes_of_the_input(spark):
    draw = random.Random(7)
    bits = ["</s>", "[INST]", " ok ", "<", "\\", "é", "[/INST]", "\n", "", "[SYS] ", "<|audio:3|>"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool"]), "".join(draw.choices(bits, k=5)) if draw.random() < 0.9 else None, "x") for c in range(30) for t in range(draw.randrange(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r, t or "") for k, _, r, t, _ in rows if k == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.format_conversations(frame.limit(0))).count() == 0


def test_repeated_windows_equal_brute_force():
    random.seed(4)
    for _ in range(60):
        words = [random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 60))]
        seen, hit = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {i + k for i in at for k in range(8)}
        assert quality.repeated_window_words(words) == len(hit)


def test_quality_on_odd_rows(spark, odd):
    rows = quality.measure_documents(odd).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 5, 6))
    assert quality.measure_documents(odd.limit(0)).count() == 0
    assert quality.rejected_by(odd).columns == odd.columns


def test_pipeline_stages_keep_columns(spark, odd, tmp_path):
    import corpus_pipeline

    odd.withColumns({c: odd["source"] for c in ("copies", "copies_", "bands", "print", "row", "family")}).write.parquet(f"{tmp_path}/odd")
    odd = spark.read.parquet(f"{tmp_path}/odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns
    assert corpus_pipeline.drop_near_copies(spark, odd, "").filter("text like 'the cat%'").count() == 1
    odd.limit(0).write.parquet(f"{tmp_path}/none")
    none = spark.read.parquet(f"{tmp_path}/none")
    assert all(stage(spark, none, "").count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(3)
    kinds = {"xx": ["ka", "to", "mi", "ru", "ne"], "yy": ["schl", "acht", "ung", "ö", "eis"]}
    write = lambda k, n: " ".join("".join(draw.choices(kinds[k], k=draw.randrange(2, 5))) for _ in range(n))
    rows = [(i, write(k, draw.randrange(30, 90)), k, draw.choice(["a", "b", None])) for i in range(160) for k in [draw.choice(list(kinds))]]
    rows += [(200 + i, rows[i][1], "xx", "b") for i in range(20)] + [(300 + i, write("xx", 5), "xx", "a") for i in range(10)]
    rows += [(400 + i, "#$ %& " * 40, "yy", "a") for i in range(5)] + [(500, None, "xx", "a"), (501, "", None, None), (502, "12 345 " * 30, "xx", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held, own = docs, sp.Codec(tokenizer_path())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, after = held.collect(), spark.read.parquet(f"{tmp_path}/{name}").collect()
        held = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if r["text"] and langid.has_letter(r["text"])}
        elif name == "quality":
            passes = lambda x: not any(rule.rejects(quality.Text(x.encode())) for rule in quality.BASE + quality.RULES)
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if passes(r["text"])} and not {r["doc_id"] for r in after} & set(range(300, 310))
        elif name == "near_copies":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(r["text"], r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(first.values())
        elif name == "mixture":
            size = lambda r: len(r["text"].split())
            sizes, taken, most = Counter(), Counter(), Counter()
            for r in before:
                sizes[r["source"]] += size(r)
                most[r["source"]] = max(most[r["source"]], size(r))
            for r in after:
                taken[r["source"]] += size(r)
            assert max(Counter(r["doc_id"] for r in after).values()) <= 3 and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            assert all(abs(taken[s] - t) <= most[s] / 2 + 1e-6 or t == 3 * sizes[s] for s, t in _filled(sizes).items())
        else:
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before) and all(r["round_trip"] and list(r["ids"]) == own.library.encode(text[r["doc_id"]]) for r in after)
    assert sorted(map(str, after)) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def _planted():
    """Texts of 40 to 400 words with copies at similarities about 0.7 to 0.97, and a chain of close ones."""
    draw, out = random.Random(8), []

    def changed(words, n):
        words = list(words)
        for i in draw.sample(range(len(words)), n):
            words[i] = f"new{draw.randrange(10**9)}"
        return words

    for _ in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([40, 150, 400]))]
        out += [words] + [changed(words, max(1, len(words) * k // 400)) for k in (2, 6, 8, 9, 10, 12, 16)]
    chain = [f"c{i}" for i in range(300)]
    for _ in range(60):
        out.append(chain := changed(chain, 3))
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_near_copies_are_those_of_brute_force(spark, tmp_path):
    import corpus_pipeline
    from docsight.llm import near_copies

    rows = _planted()
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    head = list(range(len(sets)))
    similar = []
    for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
        if sets[i] & sets[j] and (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.8:
            similar.append(s)
            a, b = sorted((head[i], head[j]))
            head = [a if x == b else x for x in head]
    assert sum(s < 0.85 for s in similar) > 20 and sum(0.85 <= s < 0.9 for s in similar) > 20 and sum(s >= 0.9 for s in similar) > 20
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/planted")
    docs = spark.read.parquet(f"{tmp_path}/planted")
    want = sorted(set(head))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    numbered = spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, row long, text string")
    assert sorted(r.row for r in near_copies.firsts(numbered, "doc_id", "row", tile=2000).collect()) == want


def test_near_copies_take_the_links_of_fingerprints(spark, tmp_path, monkeypatch):
    """Without MinHash bands: what the SimHash operator links, decided by exact similarity."""
    import corpus_pipeline
    from docsight.llm import near_copies

    rows = [*_planted(), (1000, None), (1001, ""), (1002, "a b"), (1003, "A  b")]
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()} for w in words]
    prints = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows]
    pairs = list(itertools.combinations(range(len(rows)), 2))

    def heads(linked):
        head = list(range(len(rows)))
        for i, j in pairs:
            if linked(i, j) and head[i] != head[j]:
                a, b = sorted((head[i], head[j]))
                head = [a if x == b else x for x in head]
        return head

    family = heads(lambda i, j: sets[i] == sets[j] or (prints[i] ^ prints[j]).bit_count() <= 4)
    same = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = sorted(rows[i][0] for i in set(heads(lambda i, j: family[i] == family[j] and same(i, j))))
    assert len(want) < len(rows) - 40
    monkeypatch.setattr(near_copies, "_band_links", lambda sets: spark.createDataFrame([], "a long, b long"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/planted")
    got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/planted"), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_too_many_languages_are_refused(spark):
    from pyspark.sql import functions as F

    docs = spark.range(langid.MAX_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError):
        langid.train(docs, F.lit(True))
