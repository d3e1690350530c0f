"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

The texts of a part of an Arrow batch stand one after another as bytes.  The
ends of all tokens of A, and of B, are counted at each byte at once; a place
where tokens of both end cuts all texts' tokens into groups, as every text's
end is such a place.  Sums up to each cut, taken apart at the documents' ends,
give each document its numbers of tokens, groups and links.

Every pair of tokens of A and B that share a group is a link.  Links are never
put out one by one: a group counts its distinct ids first, and a part of a
batch holds each id pair once, with the documents that hold it and how often.
How many documents hold a pair is summed over these.  The sums are joined back
by blocks of pairs, dealt so that each task holds one block of sums and reads
the parts of the corpus as a stream.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, once_a_worker, text_slices, utf8, words_between_spaces, written

#: Characters of words that a worker remembers, in each of two generations.
REMEMBERED = 1_200_000
#: Words that a library encodes at a time, and bytes of text that are aligned at a time.
WORDS_AT_A_TIME = 2048
PART_BYTES = 1 << 20
#: Stands for ids that do not spell their text: no id has its bytes.
UNSPELLED = b"\xff\xff\xff\xff"
#: Links (of distinct ids of a group) that are spread out at a time.
AT_A_TIME = 4_000_000
#: Sums of pairs in a block.
BLOCK_PAIRS = 1_000_000
#: Bytes of packed links that one task reads.
TASK_BYTES = 64 << 20
#: Ids are below 2 ** ID_BITS, documents in a part of a batch below 2 ** (64 - 2 * ID_BITS).
ID_BITS = 21

MARK = "▁"


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer: the bytes of each id, and ``encode``, which gives the ids of a space and each text of a list.

    ``apart`` says that words between single spaces may be encoded on their
    own, ``exact`` that the bytes of a text's tokens are always its own.
    """

    def __init__(self, names: dict[int, bytes], encode: Callable[[list[str]], list[list[int]]], apart: bool, exact: bool = False):
        if max(names, default=0) >> ID_BITS:
            raise ValueError(f"ids of {ID_BITS} bits at most")
        self.names, self.encode, self.apart, self.exact = names, encode, apart, exact
        self.sizes = np.zeros(max(names, default=0) + 1, dtype=np.int64)
        for i, name in names.items():
            self.sizes[i] = len(name)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Packed ids; ``UNSPELLED`` where the tokens' bytes are not the space and the text."""
        name = self.names.__getitem__
        found = self.encode(texts)
        if self.exact:
            return [array("I", ids).tobytes() for ids in found]
        return [array("I", ids).tobytes() if b"".join(map(name, ids)) == b" " + text.encode() else UNSPELLED for text, ids in zip(texts, found, strict=True)]


class Both:
    """Two tokenizers, which look a text's words up once for both."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.memo = Memo(self._encode, REMEMBERED)

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        out: list[tuple[bytes, bytes]] = []
        for at in range(0, len(texts), WORDS_AT_A_TIME):
            some = texts[at : at + WORDS_AT_A_TIME]
            out += zip(self.a.packed(some), self.b.packed(some), strict=True)
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of a space and each text by both; with ``UNSPELLED`` among them where their bytes are other than these."""
        apart = self.a.apart and self.b.apart
        split = [words_between_spaces(t) if t and apart else None for t in texts]
        get = self.memo.learn(set().union(*filter(None, split)))
        out = []
        for text, words in zip(texts, split, strict=True):
            if words:
                found = list(map(get, words))
                out.append((b"".join([x for x, _ in found]), b"".join([y for _, y in found])))
            else:
                out += self._encode([text]) if text else [(b"", b"")]
        return out


# Fixed value: how byte-level tokenizers split a text.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_side(path: str) -> Side:
    """A byte-level BPE vocabulary file of the tokenizers library; strings of special tokens are plain text.

    If every merge makes the token of the next id, ids are ranks, and the
    faster encoder by ranks gives the same tokens; else the library encodes.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    spelled = _byte_level()
    names = {i: bytes(spelled[c] for c in entry) for entry, i in held["model"]["vocab"].items() if set(entry) <= spelled.keys()}
    ids = {name: i for i, name in names.items()}
    merged = [ids.get(bytes(spelled[c] for c in "".join(m if isinstance(m, list) else m.split(" ", 1)))) for m in held["model"]["merges"]]
    exact = held["normalizer"] is None and all(bytes([b]) in ids for b in range(256))
    before = held["pre_tokenizer"]
    plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if exact and plain and merged == list(range(256, 256 + len(merged))) and len(ids) == len(names) == 256 + len(merged):
        import tiktoken

        ranks = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ids, special_tokens={})
        return Side(names, lambda texts: [ranks.encode_ordinary(" " + t) for t in texts], apart=True, exact=True)
    return Side(names, library_encode(path), apart=plain, exact=exact)


def library_encode(path: str) -> Callable[[list[str]], list[list[int]]]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return lambda texts: [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def piece_side(path: str) -> Side:
    """A SentencePiece vocabulary that puts a space before each text."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    names = {i: bytes([int(p[1:-1], 16)]) if library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
    # A piece with a space mark inside could hold the end of one word and the start of the next.
    apart = not any(MARK in p.lstrip(MARK) for p in pieces)
    return Side(names, lambda texts: library.encode(texts, num_threads=1), apart)


def sides(path_a: str, path_b: str) -> Both:
    return once_a_worker(("alignment", path_a, path_b), lambda: Both(byte_level_side(path_a), piece_side(path_b)))


class Aligned:
    """The tokens of some texts, aligned."""

    def __init__(self, both: Both, texts: list[str | None]):
        """Null and empty texts, and those that the tokens of a side do not spell, have no tokens."""
        given = [t or "" for t in texts]
        packed = both.encode_all(given)
        good = [bool(t) and UNSPELLED not in x and UNSPELLED not in y for t, (x, y) in zip(given, packed, strict=True)]
        self.docs = len(texts)
        self.a, self.of_a = self._ids([x for x, _ in packed], good)
        self.b, self.of_b = self._ids([y for _, y in packed], good)
        end_a, end_b = np.cumsum(both.a.sizes[self.a]), np.cumsum(both.b.sizes[self.b])
        length = int(end_a[-1]) + 1 if len(end_a) else 1
        # A place where tokens of both end: the number of such places before a token's end is its group.
        cuts = (np.bincount(end_a, minlength=length) > 0) & (np.bincount(end_b, minlength=length) > 0)
        upto = np.cumsum(cuts)
        self.group_a, self.group_b = upto[end_a - 1], upto[end_b - 1]
        self.groups = int(upto[-1])
        self.in_a = np.bincount(self.group_a, minlength=self.groups)
        self.in_b = np.bincount(self.group_b, minlength=self.groups)
        self.n_a, self.n_b = np.bincount(self.of_a, minlength=self.docs), np.bincount(self.of_b, minlength=self.docs)
        # Groups of document d end at its last token's group; sums of each document are differences of running sums.
        closes = np.cumsum(self.n_a)
        self.last = np.r_[0, np.where(closes > 0, np.r_[self.group_a, 0][closes - 1] + 1, 0)] if len(self.a) else np.zeros(self.docs + 1, dtype=np.int64)
        links = np.r_[0, np.cumsum(self.in_a * self.in_b)]
        self.n_groups, self.n_links = np.diff(self.last), np.diff(links[self.last])

    def _ids(self, packed: list[bytes], good: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        kept = [p if g else b"" for p, g in zip(packed, good, strict=True)]
        return np.frombuffer(b"".join(kept), dtype="<u4").astype(np.int64), np.repeat(np.arange(len(kept)), [len(k) // 4 for k in kept])

    def texts(self) -> list[str]:
        """Each document's groups as text: ids of A with commas, a bar, ids of B, groups between semicolons."""
        # Groups' tokens of A stand before those of B: a token moves by the tokens of the other side that come first.
        before_a, before_b = np.r_[0, np.cumsum(self.in_a)], np.r_[0, np.cumsum(self.in_b)]
        at = np.concatenate([np.arange(len(self.a)) + before_b[self.group_a], np.arange(len(self.b)) + before_a[self.group_b + 1]])
        ids = np.empty(len(at), dtype=np.int64)
        ids[at] = np.concatenate([self.a, self.b])
        last_a = np.r_[self.group_a[1:] != self.group_a[:-1], True] if len(self.a) else np.zeros(0, dtype=bool)
        last_b = np.r_[self.group_b[1:] != self.group_b[:-1], True] if len(self.b) else np.zeros(0, dtype=bool)
        marks = np.empty(len(at), dtype=np.uint8)
        marks[at] = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))])
        digits = len(str(int(ids.max(initial=0))))
        laid = np.empty((len(ids), digits + 1), dtype=np.uint8)
        rest = ids.copy()
        shown = np.ones((len(ids), digits + 1), dtype=bool)
        for i in range(digits - 1, -1, -1):
            laid[:, i] = rest % 10 + ord("0")
            shown[:, i] = (rest > 0) | (i == digits - 1)
            rest //= 10
        laid[:, digits] = marks
        sizes = np.r_[0, np.cumsum(shown.sum(axis=1))]
        whole = laid[shown].tobytes().decode()
        ends = sizes[np.cumsum(self.n_a + self.n_b)]
        return [whole[x : y - 1] if y > x else "" for x, y in zip(np.r_[0, ends[:-1]], ends, strict=True)]

    def links(self, most: int = AT_A_TIME) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair, document, times) for each id pair and document that link; each only once, in the order of pairs.

        A pair is A's id << ID_BITS | B's id.
        """
        one_a, a, times_a = _counted(self.group_a, self.a)
        one_b, b, times_b = _counted(self.group_b, self.b)
        first = np.searchsorted(one_b, np.arange(self.groups))
        kinds = np.diff(np.r_[first, len(one_b)])
        document = np.searchsorted(self.last[1:], np.arange(self.groups), side="right")
        order = np.argsort(a, kind="stable")
        one_a, a, times_a = one_a[order], a[order], times_a[order]
        spread = np.cumsum(kinds[one_a])
        at = 0
        while at < len(a):
            upto = int(np.searchsorted(spread, (spread[at - 1] if at else 0) + most, side="right"))
            upto = max(upto, at + 1)
            if upto < len(a):  # an id of A is never divided, unless it alone is too much
                upto = max(int(np.searchsorted(a, a[upto])), int(np.searchsorted(a, a[at], side="right")))
            g, ids, times = one_a[at:upto], a[at:upto], times_a[at:upto]
            n = kinds[g]
            row = np.repeat(np.arange(len(g)), n)
            other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[g][row]
            key = ((ids[row] << ID_BITS) | b[other]).astype(np.uint64) << np.uint64(64 - 2 * ID_BITS) | document[g][row].astype(np.uint64)
            weight = times[row] * times_b[other]
            sort = np.argsort(key, kind="stable")
            key, weight = key[sort], weight[sort]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key = key[start]
            yield (key >> np.uint64(64 - 2 * ID_BITS)).astype(np.int64), (key & np.uint64((1 << 64 - 2 * ID_BITS) - 1)).astype(np.int64), np.add.reduceat(weight, start)
            at = upto


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), in order, and how often each occurs."""
    key, times = np.unique(group << ID_BITS | ids, return_counts=True)
    return key >> ID_BITS, key & ((1 << ID_BITS) - 1), times


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text") -> DataFrame:
    """Both encodings of each text and where they meet: ``keep``, a_ids, b_ids, and for each group its last tokens' places a_ends, b_ends.

    A encodes a space and the text, B the text.  Null and empty texts, and
    those that the bytes of A's or B's tokens do not spell, have empty
    arrays.  Repeated rows each get a row, an empty table gives an empty
    result; further columns are dropped, whatever their names.
    """
    slots = [f"__k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(c).alias(s) for c, s in zip(keep, slots, strict=True)], utf8(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        for batch in batches:
            for part in text_slices(batch, len(slots), PART_BYTES):
                x = Aligned(both, _texts(part.column(len(slots))))
                upto_a, upto_b = np.r_[0, np.cumsum(x.in_a)], np.r_[0, np.cumsum(x.in_b)]
                start_a, start_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                of = np.repeat(np.arange(x.docs), x.n_groups)
                lists = [
                    _lists(x.a, x.n_a),
                    _lists(x.b, x.n_b),
                    _lists(upto_a[1:] - 1 - start_a[of], x.n_groups),
                    _lists(upto_b[1:] - 1 - start_b[of], x.n_groups),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*slots, "a_ids", "b_ids", "a_ends", "b_ends"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    out = narrow.mapInArrow(run, fields + "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")
    return out.select(*[F.col(s).alias(c) for c, s in zip(keep, slots, strict=True)], "a_ids", "b_ids", "a_ends", "b_ends")


def _texts(column: pa.Array) -> list[str | None]:
    return [None if t is None else t.decode("utf-8", "replace") for t in column.to_pylist()]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32)))


PARTS = (
    "part long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "pairs binary, held binary, documents binary, times binary"
)


def _parts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Parts of the corpus: their documents' figures, and their links packed.

    ``pairs`` are the distinct id pairs, ``held`` how many documents hold
    each, ``documents`` and ``times`` those documents' places in the part and
    how often.  Links that do not fit into one row fill rows without documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        part_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, 1, PART_BYTES):
                x = Aligned(both, _texts(part.column(1)))
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.texts()]
                one = lambda v: pa.array([v.tolist()], pa.list_(pa.int64()))
                shown = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *map(one, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array([digests], pa.list_(pa.string()))]
                none = [pa.array([[]], a.type) for a in shown]
                for pair, document, times in chain(x.links(), [] if len(x.a) else [(np.zeros(0, np.int64),) * 3]):
                    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
                    packed = pair[start].astype("<i8"), np.diff(np.r_[start, len(pair)]).astype("<u4"), document.astype("<u4"), times.astype("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part_id]), *shown, *(pa.array([p.tobytes()], pa.binary()) for p in packed)],
                        names=["part", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "held", "documents", "times"],
                    )
                    shown = none
                part_id += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, PARTS)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pairs, held) to (pair, n), summed over what a task holds at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pair, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
        return pair[start], np.add.reduceat(n[order], start) if len(pair) else n

    def out(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["pair", "n"])

    for batch in batches:
        for pairs, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((np.frombuffer(pairs, "<i8"), np.frombuffer(n, "<u4").astype(np.int64)))
            size += len(held[-1][0])
            if size > AT_A_TIME:
                held = [merged()]
                size = len(held[0][0])
                if size > AT_A_TIME // 2:
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*merged())


def _block(pair: np.ndarray, blocks: int) -> np.ndarray:
    """A pair's block: a mixed value of its bits, the same in every task."""
    x = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _packed_sums(blocks: int) -> Callable:
    """Rows (pair, n, best) to (block, pairs, n, best), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            block = _block(pair, blocks)
            for b in np.unique(block):
                own = block == b
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(b)], pa.int64()), *(pa.array([v[own].astype(t).tobytes()], pa.binary()) for v, t in ((pair, "<i8"), (n, "<i8"), (best, "u1")))],
                    names=["block", "pairs", "held", "best"],
                )

    return run


def _dealt_links(blocks: int) -> Callable:
    """Rows (part, pairs, held, documents, times) to one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, held, document, times = (np.frombuffer(p, t) for p, t in zip(packed, ("<i8", "<u4", "<u4", "<i8"), strict=True))
                block = _block(pair, blocks)
                each = np.repeat(block, held)
                for b in np.unique(block):
                    own, links = block == b, each == b
                    values = pair[own], held[own], document[links], times[links]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int64()), pa.array([int(b)], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                        names=["part", "block", "pairs", "held", "documents", "times"],
                    )

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, kind, part, pairs, held, documents, times), a block's sums first, to (part, place, n_best, count_sum)."""
    sums: list[tuple[np.ndarray, ...]] = []
    known: tuple[np.ndarray, ...] = ()
    slot = None
    for batch in batches:
        for at, kind, part, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != slot:
                slot, sums, known = at, [], ()
            if kind == 0:
                sums.append(tuple(np.frombuffer(p, t) for p, t in zip(packed[:3], ("<i8", "<i8", "u1"), strict=True)))
                continue
            if not known:
                columns = [np.concatenate(c) for c in zip(*sums, strict=True)]
                order = np.argsort(columns[0])
                known = tuple(c[order] for c in columns)
            pair, held, document, times = (np.frombuffer(p, t) for p, t in zip(packed, ("<i8", "<u4", "<u4", "<i8"), strict=True))
            found = np.searchsorted(known[0], pair)
            n, best = np.repeat(known[1][found], held), np.repeat(known[2][found], held)
            order = np.argsort(document, kind="stable")
            document = document[order]
            start = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(start), part, dtype=np.int64)),
                    pa.array(document[start].astype(np.int32)),
                    pa.array(np.add.reduceat((times * best)[order], start)),
                    pa.array(np.add.reduceat((times * n)[order], start)),
                ],
                names=["part", "place", "n_best", "count_sum"],
            )


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each linked id pair, and whether none of the same A id is held by more."""
    sums = parts.select("pairs", "held").mapInArrow(_pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # An id of A has no more pairs than B has ids.
    of_a = Window.partitionBy(F.shiftright("pair", ID_BITS))
    return sums.withColumn("best", F.col("n") == F.max("n").over(of_a))


def count_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs`` (doc_id, text).

    A link's count is the number of rows that hold its id pair linked; n_best
    counts the links whose count is the highest of their A id's pairs, ties
    included.  Null and empty texts, and those that the bytes of A's or B's
    tokens do not spell, count 0 and have groups_sha256 ''.  Null doc_ids and
    repeated rows are rows of their own, an empty table gives an empty result,
    texts of any length are aligned whole, and further columns are ignored.
    """
    spark = docs.sparkSession
    parts = written(_parts(docs, path_a, path_b))
    counts = written(pair_counts(parts))
    blocks = max(1, -(-counts.count() // BLOCK_PAIRS))
    figures = parts.agg(F.sum(F.octet_length("documents").cast("long") * 3)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-figures // TASK_BYTES))
    # A block is read by so many tasks, each of which holds its sums.
    deals = -(-tasks // blocks)
    sums = counts.mapInArrow(_packed_sums(blocks), "block long, pairs binary, held binary, best binary")
    links = parts.filter(F.octet_length("pairs") > 0).select("part", "pairs", "held", "documents", "times").mapInArrow(
        _dealt_links(blocks), "part long, block long, pairs binary, held binary, documents binary, times binary"
    )
    slot = lambda deal: (F.col("block") * deals + deal).cast("int").alias("slot")
    nothing = F.lit(None).cast("binary")
    dealt = (
        sums.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        .select(slot(F.col("deal")), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("part"), "pairs", "held", F.col("best").alias("documents"), nothing.alias("times"))
        .unionByName(links.select(slot(F.pmod(F.xxhash64("part"), F.lit(deals))), F.lit(1).alias("kind"), "part", "pairs", "held", "documents", "times"))
        .repartitionById(blocks * deals, "slot")
        .sortWithinPartitions("slot", "kind")
    )
    found = dealt.mapInArrow(_looked_up, "part long, place int, n_best long, count_sum long")
    scored = found.groupBy("part", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = parts.select("part", F.posexplode(F.arrays_zip("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")).alias("place", "d"))
    nothing_found = F.lit(0).cast("long")
    return rows.join(scored, ["part", "place"], "left").select(
        *[F.col(f"d.{c}").alias(n) for c, n in (("doc_ids", "doc_id"), ("n_a", "n_a"), ("n_b", "n_b"), ("n_groups", "n_groups"), ("n_links", "n_links"))],
        F.coalesce("n_best", nothing_found).alias("n_best"),
        F.coalesce("count_sum", nothing_found).alias("count_sum"),
        F.col("d.digests").alias("groups_sha256"),
    )
