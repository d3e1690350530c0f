"""Byte-level BPE, alignment of tokenizers and the divergence audit against libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from docsight.llm import alignment, byte_bpe, divergence
from docsight.llm.queries import OP13_SQL, op11_byte_bpe, op12_alignment, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, ids string, n_tokens int, `__k0` int"
ODD = [
    (1, None, "en", "a", "s", 1, 1),
    (2, "", None, None, None, None, None),
    (None, "The cat's 12 dogs aren't   here\n\n  so\t\t… <|endoftext|> ", "en", "a", "s", 1, 1),
    (3, "der Hund und die Katze öü 漢字 😀 ﷽ ​ ▁x" * 3, "de", "b", "s", 1, 1),
    (3, "der Hund und die Katze öü 漢字 😀 ﷽ ​ ▁x" * 3, "de", "b", "s", 1, 1),
    (4, "a b  c " * 5_000, "de", "b", "s", 1, 1),
    (5, "xy" * 8_000, "de", "b", "s", 1, 1),
    (6, "\r\n \n\n \t \v", "de", "c", "s", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(ranks, library):
    own = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    plain = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN, cut_by_spaces=False)
    random.seed(1)
    parts = ["x", "xx", "é", "漢字", " ", "  ", "\n", "aaaa", "ab", "ба", "123", "​", "😀", "zzz", "ing", "'s", "https://", "____", "=====", "\t", "\xa0", "ǅ"]
    texts = ["".join(random.choices(parts, k=random.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t), t
    assert own.encode_all(texts) == plain.encode_all(texts)
    for t in ("ab" * 50_000, "é" * 20_000, " " * 3000 + "a", "=" * 9999 + "-"):
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_byte_bpe_goes_back():
    """The longest first token is wrong here: a|bc merges first, so 'ab' never forms."""
    own = byte_bpe.ByteBpe({bytes([b]): 10 + b for b in range(256)} | {b"bc": 0, b"ab": 1, b"abd": 2}, r"\w+")
    assert own.encode("abc") == own.merge(b"abc") == [10 + 97, 0]
    assert own.encode("abd") == [2]
    random.seed(2)
    for _ in range(500):
        tokens = {bytes([b]): 1000 + b for b in range(256)}
        for rank in range(12):  # each new token merges two that are there
            tokens.setdefault(random.choice([t for t in tokens if set(t) <= set(b"ab")]) + random.choice([t for t in tokens if set(t) <= set(b"ab")]), rank)
        own = byte_bpe.ByteBpe(tokens, r"\w+")
        text = "".join(random.choices("ab", k=14))
        assert own.encode(text) == ([tokens[text.encode()]] if text.encode() in tokens else own.merge(text.encode()))
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 1}, r"\w+")


def test_encode_odd_texts(spark, odd, library):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode(odd, path, public_tokenizers.PATTERN, ["doc_id", "ids", "__k0"])
    assert out.columns == ["doc_id", "ids", "__k0", "ids", "n_tokens"]
    tokens = byte_bpe.encode(odd, path, public_tokenizers.PATTERN, ["doc_id", "text"])
    rows = byte_bpe.decode(tokens, path).select("*", byte_bpe.unpacked().alias("listed")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = None if r["text"] is None else library.encode_ordinary(r["text"])
        assert r["listed"] == want and r["n_tokens"] == len(want or [])
        assert (None if r["decoded"] is None else bytes(r["decoded"])) == (None if r["text"] is None else r["text"].encode())
    assert byte_bpe.decode(tokens.limit(0), path).count() == 0


def test_op11_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_byte_bpe(spark, sf).collect()}
    ids = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert got == {
        k: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest()) for k, x in ids.items()
    }


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path()


@cache
def libraries(paths):
    library = Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def aligned_by_hand(paths, text):
    """Ids of A and B and their groups, one token after another."""
    library, pieces = libraries(paths)
    a = library.encode(" " + text, add_special_tokens=False).ids if text else []
    b = pieces.encode(text) if text else []
    spelled = alignment._byte_level()
    name_a = [bytes(spelled[c] for c in library.id_to_token(i)) for i in a]
    name_b = [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(name_a) != (" " + text).encode() or b"".join(name_b) != (" " + text).encode():
        return [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in name_a]).tolist(), np.cumsum([len(x) for x in name_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


def counted_by_hand(paths, texts):
    found = [aligned_by_hand(paths, t) for t in texts]
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for _, _, groups in found]
    held = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (a, b, groups), c in zip(found, links, strict=True):
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), sum(c.values()), sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()), digest))
    return out


def test_alignment_odd_texts(spark, odd, paths, monkeypatch):
    want = sorted(map(str, counted_by_hand(paths, [r[1] for r in ODD])))
    got = alignment.count_documents(odd, *paths).collect()
    assert sorted(str(tuple(r)[1:]) for r in got) == want
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    # Blocks of few pairs, and parts of a few bytes.
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 7)
    assert sorted(str(tuple(r)[1:]) for r in alignment.count_documents(odd, *paths).collect()) == want
    assert alignment.count_documents(odd.limit(0), *paths).count() == 0
    rows = alignment.align(odd, *paths, ["doc_id", "ids", "text"]).collect()
    for r in rows:
        a, b, groups = aligned_by_hand(paths, r["text"])
        assert r["a_ids"] == a and r["b_ids"] == b
        assert [x + 1 for x in r["a_ends"]] == np.cumsum([len(g) for g, _ in groups]).tolist()
        assert [x + 1 for x in r["b_ends"]] == np.cumsum([len(h) for _, h in groups]).tolist()


def test_op12_by_hand(spark, paths):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in docs], counted_by_hand(paths, [r[1] for r in docs]), strict=True))
    assert {r["doc_id"]: tuple(r)[1:] for r in op12_alignment(spark, sf).collect()} == want


def test_alignment_spreads_links_in_slices(paths):
    both = alignment.sides(*paths)
    random.seed(3)
    texts = ["".join(random.choices("漢字ñ€\u200bβ𝛼qxz \n", k=k)) for k in (0, 5, 200, 900)] + [None, "a ▁", "the cat"]
    x = alignment.Aligned(both, texts)
    whole = list(x.links())
    sliced = list(x.links(most=50))
    assert len(whole) == 1 and len(sliced) > 3
    for a, b in zip(whole[0], (np.concatenate(c) for c in zip(*sliced, strict=True)), strict=True):
        assert (a == b).all()
    assert [int(n) for n in x.n_links] == [r[3] for r in counted_by_hand(paths, texts)]


def test_words_apart_give_the_same_tokens(paths):
    both = alignment.sides(*paths)
    random.seed(5)
    marks = [" ", "  ", "\n", "\t", "\xa0", "\u3000", "\x1c", "x", "ab", "12", "'s", "é", "漢", "…", "<s>", "<|endoftext|>", "-", "▁"]
    texts = ["".join(random.choices(marks, k=12)) for _ in range(3000)] + [f"ab{chr(c)} {chr(c)}d {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    spelled = lambda p: tuple(alignment.UNSPELLED if alignment.UNSPELLED in x else x for x in p)
    assert list(map(spelled, both.encode_all(texts))) == list(map(spelled, both._encode(texts)))
    library = alignment.library_encode(paths[0])
    assert library(texts) == both.a.encode(texts)
    words = open(__file__, encoding="utf-8").read().split()
    assert library(words) == both.a.encode(words)


def audited_by_sql(rows, least):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    return sorted(map(tuple, con.execute(OP13_SQL.replace(">= 30", f">= {least}")).fetchall()))


def test_divergence_equals_sql(spark, odd):
    draw = random.Random(6)
    words = ["the", "THE", "Cat", "dog-1", "été", "Été", "漢字", "z9z", "a_b", "Q"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [
        (i, " ".join(draw.choices(words, k=draw.randrange(12))) or None, draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", "é", None, ""]))
        for i in range(300)
    ]
    rows += [(1, None, "xx", "only"), (1, "12 !", "xx", "two"), (2, "lone", "yy", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for least in (1, 9):
        want = audited_by_sql(rows, least)
        assert sorted(map(tuple, divergence.audit(docs, least=least).collect())) == want
        # So few places that sums of pairs and runs of terms are passed on in parts.
        assert sorted(map(tuple, divergence.audit(docs, least=least, places=12).collect())) == want
    assert {r[5] for r in want if r[2] == "pair"} >= {1, 2, 3}
    want = audited_by_sql([r[:4] for r in ODD], 2)
    assert sorted(map(tuple, divergence.audit(odd.withColumn("term", odd.text), least=2).collect())) == want
    assert divergence.audit(odd.limit(0)).count() == 0


def test_divergence_in_small_parts(spark, monkeypatch):
    """Runs that go over the edges of batches and of what a task holds."""
    monkeypatch.setattr(divergence, "HELD_RUNS", 20)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        draw = random.Random(8)
        rows = [(i, " ".join(draw.choices("abcdefgh", k=9)), "en", f"s{draw.randrange(9)}") for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        assert sorted(map(tuple, divergence.audit(docs).collect())) == audited_by_sql(rows, 30)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_shares_are_exact():
    draw = random.Random(9)
    for _ in range(2000):
        kept = draw.randrange(1, 10**6)
        n = draw.randrange(10 ** draw.randrange(1, 15))
        total = n + draw.randrange(10 ** draw.randrange(1, 15))
        got = divergence.shares(np.array([n]), np.array([total]), kept)[0]
        assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
