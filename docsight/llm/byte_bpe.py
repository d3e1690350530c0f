"""Byte-level BPE encoding and decoding by backtracking over the longest matches.

A text is split by a pattern, and each distinct piece, or word between spaces,
is encoded once and remembered.  The bytes of new pieces stand as Latin-1 characters in one
string, a character outside Latin-1 between them, and an Aho-Corasick
automaton over the vocabulary finds the longest token that starts at each
byte in one pass.

A sequence of tokens is what merging by rank would give exactly if merging
each token's bytes gives that token and merging the bytes of each two
neighbours gives these two.  So a piece is encoded from left to right: take
the longest token that is compatible with the one before, else a shorter one,
else go a token back.  A prefix has one compatible sequence at most, so a
place that was left by going back is never tried again, and each piece takes
linear time.  Compatibility of neighbours is remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, once_a_worker, text_slices, utf8, words_between_spaces

#: Outside Latin-1, so part of no token.
BETWEEN = "Ā"
#: Characters of words that a worker remembers, and of pieces, in each of two generations.
REMEMBERED = 1_500_000
REMEMBERED_PIECES = 500_000
#: Pieces of a text that are held as separate strings at a time.
AT_A_TIME = 65_536
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    """A vocabulary of byte strings by rank, and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_by_spaces: bool = True):
        """``cut_by_spaces``: no match of the pattern holds both a space and what stands before it,
        unless white space stands on both sides of the space."""
        import ahocorasick
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary holds every byte: {missing[:5]} are missing")
        self.ranks, self.pattern, self.cut_by_spaces = ranks, regex.compile(pattern), cut_by_spaces
        self.names: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        if len(self.names) < len(ranks):
            raise ValueError("two tokens have one rank")
        self.automaton = ahocorasick.Automaton()
        self.single = [ranks[bytes([b])] for b in range(256)]
        for token, rank in ranks.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.fits = lru_cache(maxsize=1 << 18)(self._fits)
        self.edges = lru_cache(maxsize=1 << 16)(self._edges)
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.names}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.shorter = {rank: self._shorter(token) for token, rank in ranks.items()}
        self.pieces = Memo(self.encode_pieces, REMEMBERED_PIECES)
        self.words = Memo(self._encode_words, REMEMBERED)

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a short byte string by merging: the pair of lowest rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank_of = self.ranks.get
        ranks = [rank_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = rank_of(parts[i] + parts[i + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """The tokens that stand at the right and at the left edge of a token's bytes while they are merged.

        Each with the rank at which it is merged further; None if merging does not give the token.
        """
        nodes: list[tuple] = [(bytes([b]), None) for b in self.names[token]]
        rank_of = self.ranks.get
        ranks = [rank_of(a[0] + b[0], NEVER) for a, b in zip(nodes, nodes[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                return None
            at = ranks.index(least)
            nodes[at : at + 2] = [(nodes[at][0] + nodes[at + 1][0], nodes[at : at + 2])]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = rank_of(nodes[i][0] + nodes[i + 1][0], NEVER)
        out = []
        for side in (1, 0):
            node, up, spine = nodes[0], NEVER, []
            while True:
                spine.append((node[0], up))
                if node[1] is None:
                    break
                node, up = node[1][side], self.ranks[node[0]]
            out.append(spine[::-1])
        return tuple(out)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both: no two tokens that meet at the seam are merged there.

        Tokens at the seam give way as they are merged with others of their
        side, in the order of ranks; of equal ranks the left goes first.
        """
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return False
        i = j = 0
        rank_of = self.ranks.get
        while True:
            (x, up_x), (y, up_y) = a[0][i], b[1][j]
            rank = rank_of(x + y, NEVER)
            if rank < up_x and rank <= up_y and rank != NEVER:
                return False
            if up_x <= up_y:
                if up_x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _shorter(self, token: bytes) -> int | None:
        """The longest token that the token's bytes begin with, itself left out."""
        found = (self.ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
        return next((rank for rank in found if rank is not None), None)

    def _trace(self, longest: list[int], start: int, stop: int) -> list[int]:
        """Tokens of the bytes from ``start`` to ``stop``, given the longest token at each of them."""
        sizes, fits, edges, shorter = self.sizes, self.fits, self.edges, self.shorter
        out: list[int] = []
        left_for_good: set[int] = set()
        at, last, token = start, None, longest[start]
        while at < stop:
            while token is not None:
                end = at + sizes[token]
                if (edges(token) is not None if last is None else fits(last, token)) and end not in left_for_good:
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, last, token = end, token, longest[end]
            else:
                left_for_good.add(at)
                token = out.pop()
                at -= sizes[token]
                last, token = out[-1] if out else None, shorter[token]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Tokens of each piece as little-endian 32-bit integers."""
        out: list[bytes | None] = []
        rest: list[tuple[int, bytes]] = []
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            rank = self.ranks.get(raw)
            out.append(None if rank is None else self.packed[rank])
            if rank is None:
                rest.append((i, raw))
        if rest:
            # The longest token at each byte: its own, unless a match starts there; ends rise, so the longest comes last.
            longest = list(map(self.single.__getitem__, b"\0".join([raw for _, raw in rest]) + b"\0"))
            for end, (rank, before) in self.automaton.iter(BETWEEN.join([raw.decode("latin-1") for _, raw in rest])):
                longest[end - before] = rank
            at = 0
            for i, raw in rest:
                out[i] = b"".join(map(self.packed.__getitem__, self._trace(longest, at, at + len(raw))))
                at += len(raw) + 1
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        split = [self.pattern.findall(" " + w) for w in words]
        get = self.pieces.learn(set().union(*split))
        return [b"".join(map(get, p)) for p in split]

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Tokens of whole texts as little-endian 32-bit integers.

        Where the pattern is ``cut_by_spaces``, a text's words between spaces
        are looked up whole; texts with a space beside other white space are
        split by the pattern.
        """
        words = [words_between_spaces(t) if t and self.cut_by_spaces else None for t in texts]
        get = self.words.learn(set().union(*(w[1:] for w in words if w)))
        out: list[bytes | None] = []
        for text, w in zip(texts, words, strict=True):
            if text is None:
                out.append(None)
            elif w:
                out.append(b"".join([*self._in_parts(w[0]), *map(get, w[1:])]))
            else:
                out.append(b"".join(self._in_parts(text)))
        return out

    def _in_parts(self, text: str) -> Iterator[bytes]:
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, AT_A_TIME)):
            yield from map(self.pieces.learn(set(part)), part)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


def read_names(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def opened(path: str, pattern: str) -> ByteBpe:
    return once_a_worker(("byte_bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Token ids of every whole text: the columns ``keep``, then ``ids`` as little-endian 32-bit integers and n_tokens.

    Null texts have null ids and 0 tokens, empty ones empty ids; texts of any
    length are encoded whole, piece by piece; bytes that are no UTF-8 count as
    U+FFFD.  Repeated rows each get a row, an empty table gives an empty
    result, and columns other than ``keep``, whatever their names, are
    dropped.  ``path`` must be readable on every worker.
    """
    slots = [f"__k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(c).alias(s) for c, s in zip(keep, slots, strict=True)], utf8(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(path, pattern)
        for batch in batches:
            for part in text_slices(batch, len(slots)):
                texts = [None if t is None else t.decode("utf-8", "replace") for t in part.column(len(slots)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own.encode_all(texts), pa.binary())], names=[*slots, "ids"])

    kept = narrow.select(*slots)
    out = narrow.mapInArrow(run, f"{_fields(kept)}{', ' if slots else ''}ids binary")
    return out.select(
        *[F.col(s).alias(c) for c, s in zip(keep, slots, strict=True)],
        "ids",
        F.coalesce((F.octet_length("ids") / 4).cast("long"), F.lit(0).cast("long")).alias("n_tokens"),
    )


def unpacked(ids: str = "ids") -> F.Column:
    """Ids as an array: four bytes each, the lowest first."""
    pair = lambda i, k: F.hex(F.substr(ids, i * 4 + k + 1, F.lit(1)))
    number = lambda i: F.conv(F.concat(pair(i, 3), pair(i, 2), pair(i, 1), pair(i, 0)), 16, 10).cast("long")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).when(n == 0, F.array().cast("array<long>"))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The bytes of packed ids, as a further column ``into``; other columns pass through.

    Null ids give null, empty ids empty bytes; an id that the vocabulary does
    not have raises an error.  Repeated rows and empty tables pass as they are.
    """
    names = [f"__c{i}" for i in range(len(tokens.columns))]
    at = tokens.columns.index(ids)
    plain = tokens.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = once_a_worker(("byte_bpe names", path), lambda: read_names(path)).__getitem__
        for batch in batches:
            for part in text_slices(batch, at):
                packed = part.column(at).to_pylist()
                texts = [None if x is None else b"".join(map(name, np.frombuffer(x, dtype="<u4").tolist())) for x in packed]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    out = plain.mapInArrow(run, f"{_fields(plain)}, decoded binary")
    return out.toDF(*tokens.columns, into)
