"""SentencePiece encoding and decoding with a max-plus parallel scan over giant texts.

An encoding is a best path through the lattice of pieces.  For a unigram
model an edge weighs its piece's score.  For a BPE model a sequence is the
encoding exactly if every two neighbours stay apart when merged on their own,
so an edge weighs 0 if its piece and the one before stay apart and minus
infinity if not: the best path is then the model's own encoding.

Giant texts are cut into chunks at any character.  A chunk's matrix says,
for each state at its start (the last piece that ends there or before), with
what weight each state at its end is reached.  Matrices combine by
(max, +), which is associative; the combination fixes every chunk's states,
and each chunk is then traced back on its own.

No piece spans the place between another character and a following space
mark if the model has no such piece.  There all states meet in one: the matrix
of a span between two such places is one number, and for BPE that is 0, the
weight of the one path that joins them.  So only the ends of a chunk are
walked for its matrix; its spans are walked when it is traced back, once each,
and remembered.  Texts of up to ``GIANT`` characters are encoded whole by the
library, which gives the same ids.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MARK = "▁"
#: Texts of more characters are cut into chunks.
GIANT = 32_768
CHUNK = 16_384
#: Spans that a worker remembers, of the library's words in each of two generations.
REMEMBERED = 150_000

State = tuple[int, str]  # where the last piece ends, and the piece


class Pieces:
    """A vocabulary: pieces, scores and byte fallback of a SentencePiece model."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int] | None, unknown: int, bpe: bool):
        self.pieces, self.bytes, self.unknown, self.bpe = pieces, bytes_, unknown, bpe
        self.longest = max(map(len, pieces), default=1)
        self.low = min((s for _, s in pieces.values()), default=0.0) - 10.0
        #: Longest piece by its first two characters.
        self.reach: dict[str, int] = {}
        for p in pieces:
            self.reach[p[:2]] = max(len(p), self.reach.get(p[:2], 1))
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.apart = lru_cache(maxsize=1 << 18)(self._apart)
        self.whole = lru_cache(maxsize=1 << 16)(self._whole)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("a model that normalises texts is not supported: the scan reads characters as they stand")
        kinds = proto.ModelProto.SentencePiece
        plain = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        spelled = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        unknown = next((i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN), 0)
        return cls(plain, [spelled[b] for b in range(256)] if len(spelled) == 256 else None, unknown, m.trainer_spec.model_type == proto.TrainerSpec.BPE)

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored pair first, the leftmost of equals."""
        parts, pieces, none = list(text), self.pieces, (0, -float("inf"))
        scores = [pieces.get(a + b, none)[1] for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none[1]:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = pieces.get(parts[at - 1] + parts[at], none)[1]
            if at < len(scores):
                scores[at] = pieces.get(parts[at] + parts[at + 1], none)[1]
        return parts

    def _whole(self, piece: str) -> bool:
        return self.merge(piece) == [piece]

    def _apart(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def weight(self, before: str, piece: str) -> float | None:
        """Of the edge for ``piece`` after ``before`` ('' at a place that no piece spans); None: no edge."""
        if not self.bpe:
            return self.pieces[piece][1] if piece in self.pieces else self.low
        if not before:
            return 0.0 if len(piece) == 1 or self.whole(piece) else None
        return 0.0 if self.apart(before, piece) else None

    def ids(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def ends(self, text: str, start: int) -> Iterator[int]:
        """Ends of the pieces at a place; a single character is always a piece."""
        yield start + 1
        for end in range(start + 2, min(len(text), start + self.longest) + 1):
            if text[start:end] in self.pieces:
                yield end

    def is_cut(self, text: str, at: int) -> bool:
        return self.cuts and 0 < at < len(text) and text[at] == MARK and text[at - 1] != MARK


def span_ends(model: Pieces, text: str, start: int, stop: int) -> list[int]:
    """Places from ``start`` to ``stop`` that no piece spans."""
    return [i for i in range(start, stop + 1) if model.is_cut(text, i)] if model.cuts else []


def entry_states(model: Pieces, text: str, at: int) -> list[State]:
    """States in which a path can come to ``at``: the last piece that ends there or before, the next one ending after."""
    if at == 0:
        return [(0, "")]
    out = []
    for end in range(at, max(-1, at - model.longest), -1):
        if end == 0 or model.is_cut(text, end):
            return [*out, (end, "")]
        out += [(end, text[s:end]) for s in range(max(0, end - model.longest), end) if s == end - 1 or text[s:end] in model.pieces]
    return out


def walk(model: Pieces, text: str, entries: list[State], start: int, stop: int) -> tuple[dict, dict]:
    """Best paths from each entry state over pieces that end after ``start`` and not after ``stop``.

    Returns ``reached`` {state: {entry: weight}} of all states and
    ``back`` {(state, entry): the state before}.
    """
    reached: dict[State, dict[State, float]] = {}
    back: dict[tuple[State, State], State] = {}
    places: dict[int, list[State]] = {}
    for e in entries:
        reached[e] = {e: 0.0}
        places.setdefault(e[0], []).append(e)
    for place in range(min(places, default=stop), stop):
        for state in places.get(place, ()):
            for end in model.ends(text, place):
                if end <= start or end > stop:
                    continue
                weight = model.weight(state[1], text[place:end])
                if weight is None:
                    continue
                new = (end, "" if model.is_cut(text, end) else text[place:end])
                into = reached.get(new)
                if into is None:
                    into = reached[new] = {}
                    places.setdefault(end, []).append(new)
                for entry, w in reached[state].items():
                    if entry not in into or w + weight > into[entry]:
                        into[entry] = w + weight
                        back[new, entry] = state
    return reached, back


def path(back: dict, state: State, entry: State, text: str) -> list[str]:
    """Pieces from an entry state to a state."""
    out = []
    while state != entry:
        before = back[state, entry]
        out.append(text[before[0] : state[0]])
        state = before
    return out[::-1]


def lone_path(model: Pieces, text: str) -> list[str]:
    """Pieces of the best path through a span that begins and ends where no piece reaches over.

    For BPE one path alone weighs 0: it is searched for depth first, longer
    pieces first, leaving out states that were found to lead nowhere.
    """
    n = len(text)
    if not model.bpe:
        reached, back = walk(model, text, [(0, "")], 0, n)
        leave = max((x for x in reached if x[0] == n), key=lambda x: (reached[x][0, ""], x))
        return path(back, leave, (0, ""), text)
    pieces, reach, whole, apart, out, dead = model.pieces, model.reach, model.whole, model.apart, [], set()
    tried = [min(n, reach.get(text[:2], 1))]  # for each place on the path the next end to try
    at = 0
    while at < n:
        before, end = out[-1] if out else "", tried[-1]
        while end > at:
            piece = text[at:end]
            if end == at + 1 or piece in pieces:
                if (apart(before, piece) if before else end == 1 or whole(piece)) and not (dead and (end, piece) in dead):
                    break
            end -= 1
        if end > at:
            tried[-1] = end - 1
            out.append(piece)
            at = end
            tried.append(min(n, at + reach.get(text[at : at + 2], 1)))
        else:
            tried.pop()
            dead.add((at, out[-1]))
            at -= len(out.pop())
    return out


Matrix = dict[tuple[State, State], float]


def transfer(model: Pieces, text: str, start: int, stop: int) -> Matrix:
    """The chunk's matrix {(entry, exit): weight}; only ``text`` within three pieces' length of it is looked at.

    Between its first and last place that no piece spans, the chunk has one
    state; for BPE the weight between them is 0.
    """
    entries = entry_states(model, text, start)
    inner = span_ends(model, text, start + 1, stop) if model.bpe else []
    exits = set(entry_states(model, text, stop))
    if not inner:
        reached = walk(model, text, entries, start, stop)[0]
        return {(e, x): w for x in exits if x in reached for e, w in reached[x].items()}
    first, last = (inner[0], ""), (inner[-1], "")
    head = walk(model, text, entries, start, first[0])[0].get(first, {})
    tail = walk(model, text, [last], last[0], stop)[0]
    return {(e, x): w + tail[x][last] for e, w in head.items() for x in exits if x in tail}


def combine(left: Matrix, right: Matrix) -> Matrix:
    """The (max, +) product of the matrices of neighbouring chunks."""
    rows: dict[State, list] = {}
    for (mid, x), w in right.items():
        rows.setdefault(mid, []).append((x, w))
    out: Matrix = {}
    for (e, mid), v in left.items():
        for x, w in rows.get(mid, ()):
            if (e, x) not in out or v + w > out[e, x]:
                out[e, x] = v + w
    return out


def solve(matrices: list[Matrix], end: int) -> list[tuple[State, State]]:
    """Entry and exit state of every chunk on the best path: products up a tree, states down again."""

    def up(a: int, b: int) -> tuple:
        if b - a == 1:
            return matrices[a], None, None
        m = (a + b) // 2
        left, right = up(a, m), up(m, b)
        return combine(left[0], right[0]), left, right

    out: list[tuple[State, State]] = []

    def down(node: tuple, entry: State, leave: State) -> None:
        _, left, right = node
        if left is None:
            out.append((entry, leave))
            return
        mids = {m: w for (e, m), w in left[0].items() if e == entry}
        best = max((m for m in mids if (m, leave) in right[0]), key=lambda m: (mids[m] + right[0][m, leave], m))
        down(left, entry, best)
        down(right, best, leave)

    tree = up(0, len(matrices))
    leave = max(((w, x) for (e, x), w in tree[0].items() if e == (0, "") and x[0] == end))[1]
    down(tree, (0, ""), leave)
    return out


def trace(model: Pieces, text: str, entry: State, leave: State, start: int, stop: int, spans) -> list[int]:
    """Ids of the pieces that end in the chunk, given its states; ``spans`` encodes whole spans."""
    inner = span_ends(model, text, max(start + 1, entry[0]), stop) if model.bpe else []
    if not inner:
        back = walk(model, text, [entry], start, stop)[1]
        return [i for p in path(back, leave, entry, text) for i in model.ids(p)]
    first, last = (inner[0], ""), (inner[-1], "")
    out = [i for p in path(walk(model, text, [entry], start, first[0])[1], first, entry, text) for i in model.ids(p)]
    for a, b in zip(inner, inner[1:], strict=False):
        out += spans(text[a:b])
    return out + [i for p in path(walk(model, text, [last], last[0], stop)[1], leave, last, text) for i in model.ids(p)]


class Codec:
    """Encodes and decodes whole texts; opened once in each Python worker."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = Pieces.load(model_path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        #: One object for each number, so that ids in use lie close together.
        self.numbers = list(range(self.library.get_piece_size()))
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.paths: dict[str, list[int]] = {}
        self.names: list[str | None] = [None] * self.library.get_piece_size()
        for p, (i, _) in self.model.pieces.items():
            self.names[i] = p.replace(MARK, " ")
        self.bytes = {i: b for b, i in enumerate(self.model.bytes or [])}

    def walked(self, marked: str) -> list[int]:
        """Ids of a span that starts with space marks, by the lattice."""
        found = self.paths.get(marked)
        if found is None:
            if len(self.paths) > REMEMBERED:
                self.paths.clear()
            found = self.paths[marked] = [i for p in lone_path(self.model, marked) for i in self.model.ids(p)]
        return found

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of whole texts by the library: words between single spaces are encoded once each and remembered.

        Words of the last texts are kept in two generations, so that common ones survive.
        """
        split = [t.split(" ") if t and self.model.cuts and not (MARK in t or "  " in t or t[0] == " " or t[-1] == " ") else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        new = set().union(*filter(None, split)) - self.known.keys()
        again = new & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        fresh = list(new - again)
        shared = self.numbers.__getitem__
        self.known.update(zip(fresh, (tuple(map(shared, ids)) for ids in self.library.encode(fresh)), strict=True))
        get = self.known.__getitem__
        return [None if t is None else list(chain.from_iterable(map(get, w))) if w else self.library.encode(t) if t else [] for t, w in zip(texts, split, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are put together to characters; the first space mark was added when encoding."""
        try:
            text = "".join(map(self.names.__getitem__, ids))
        except TypeError:  # a byte or an unknown piece
            out = bytearray()
            for i in ids:
                if i in self.bytes:
                    out.append(self.bytes[i])
                else:
                    out += (" ⁇ " if self.names[i] is None else self.names[i]).encode()
            text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_OPEN: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _OPEN:
        _OPEN[model_path] = Codec(model_path)
    return _OPEN[model_path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _giant_ids(giants: DataFrame, model_path: str) -> DataFrame:
    """(key, ids) for distinct giant texts (key, text), by the scan."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = 3 * codec(model_path).model.longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = marked(text)
                n = -(-len(whole) // CHUNK)
                for i in range(n):  # a few chunks at a time
                    a, b = i * CHUNK, min(len(whole), (i + 1) * CHUNK)
                    at = max(0, a - halo)
                    yield pa.RecordBatch.from_pydict(
                        {"key": pa.array([key], pa.string()), "i": pa.array([i], pa.int32()), "at": pa.array([at], pa.int64()), "start": pa.array([a - at], pa.int64()), "part": [whole[at : min(len(whole), b + 1)]], "last": [b == len(whole)]}
                    )

    parts = cut(giants.mapInArrow(chunks, "key string, i int, at long, start long, part string, last boolean").repartition("key", "i"))

    def stop_of(part: str, last: bool) -> int:
        return len(part) if last else len(part) - 1

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path).model
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                m = transfer(model, r["part"], r["start"], stop_of(r["part"], r["last"]))
                at = r["at"]
                out.append(pickle.dumps(({((e[0] + at, e[1]), (x[0] + at, x[1])): w for (e, x), w in m.items()}, at + stop_of(r["part"], r["last"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "i", "matrix"])

    def states(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("i").to_pylist(), t.column("matrix").to_pylist(), strict=True))
        held = [pickle.loads(m) for _, m in rows]
        found = solve([m for m, _ in held], held[-1][1])
        return pa.table(
            {"key": pa.array([key[0].as_py()] * len(rows), pa.string()), "i": pa.array([i for i, _ in rows], pa.int32()), "states": pa.array([pickle.dumps(f) for f in found], pa.binary())}
        )

    solved = (
        parts.mapInArrow(matrices, "key string, i int, matrix binary").groupBy("key").applyInArrow(states, "key string, i int, states binary")
    )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                entry, leave = ((p - r["at"], u) for p, u in pickle.loads(r["states"]))
                out.append(trace(own.model, r["part"], entry, leave, r["start"], stop_of(r["part"], r["last"]), own.walked))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["key", "i", "ids"])

    pieces = parts.join(solved, ["key", "i"]).mapInArrow(traced, "key string, i int, ids array<int>")
    return pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model_path: str, keep: list[str], text: str = "text", giant: int = GIANT) -> DataFrame:
    """Token ids of every whole text: ``keep``, ids, n_tokens, round_trip.

    round_trip says that the ids decode to the text; it fails only where the
    text holds U+2581 itself, which the model reads as a space.  Null texts
    have null ids, 0 tokens and a true round_trip; empty texts an empty
    array; an empty table gives an empty result.  Repeated giant texts are
    encoded once.  ``model_path`` must be readable on every worker.  Columns
    other than ``keep``, whatever their names, are dropped.
    """
    slots = [f"__k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(c).alias(s) for c, s in zip(keep, slots, strict=True)], F.col(text).alias("__text"))
    small = narrow.filter(F.col("__text").isNull() | (F.length("__text") <= giant))
    large = narrow.filter(F.length("__text") > giant).withColumn("__key", F.sha2(F.col("__text").cast("binary"), 256))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    result = "__ids array<int>, __n long, __back boolean"

    def checked(own: Codec, texts: list, encoded: list) -> list[pa.Array]:
        offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
        offsets[1:] = np.cumsum([len(x) if x is not None else 0 for x in encoded])
        flat = np.fromiter(chain.from_iterable(x for x in encoded if x), dtype=np.int32, count=int(offsets[-1]))
        missing = pa.array([x is None for x in encoded], pa.bool_())
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing)
        back = [x is None or own.decode(x) == t for t, x in zip(texts, encoded, strict=True)]
        return [ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(back, pa.bool_())]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        names = [*slots, "__ids", "__n", "__back"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                encoded = own.encode_all(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *checked(own, texts, encoded)], names=names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts, encoded = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *checked(own, texts, encoded)], names=["__key", "__ids", "__n", "__back"])

    texts = large.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"])
    giants = texts.join(_giant_ids(texts, model_path), "key").mapInArrow(check, f"__key string, {result}")
    both = small.mapInArrow(plain, f"{fields}, {result}").unionByName(large.select(*slots, "__key").join(giants, "__key").drop("__key"))
    return both.select(
        *[F.col(s).alias(c) for c, s in zip(keep, slots, strict=True)],
        F.col("__ids").alias("ids"),
        F.col("__n").alias("n_tokens"),
        F.col("__back").alias("round_trip"),
    )
