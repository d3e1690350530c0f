"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained
by follow-the-regularised-leader with elastic-net penalties, its
probabilities calibrated by one temperature.

Document frequencies cover every training row.  The regression itself is
fitted on a bounded sample: at most about ``SAMPLE_ROWS`` labelled rows, as
evenly over the languages as they allow, chosen by a hash of doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
ORDERS = 3
SAMPLE_ROWS = 12_000
MAX_LANGUAGES = 1000
#: Code points hashed at once; longer texts are taken block by block.
BLOCK = 1 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed character 1- to 3-grams of a lower-cased text."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(points), BLOCK):
        part = points[max(0, at - ORDERS + 1) : at + BLOCK]
        new = len(points[at : at + BLOCK])
        code = np.zeros(len(part), dtype=np.uint32)
        for order in range(1, ORDERS + 1):
            code = code * np.uint32(0x01000193) + part if order == 1 else code[:-1] * np.uint32(0x01000193) + part[order - 1 :]
            mixed = (code ^ np.uint32(order * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed = mixed * np.uint32(0x85EBCA6B)
            counts += np.bincount(mixed[-new:] >> np.uint32(32 - FEATURE_BITS), minlength=FEATURES)
    return counts


def _text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def has_letter(text: str) -> bool:
    """Numerals that are no digits, such as Roman or raised ones, are no letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties; the last feature is the bias."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z = np.zeros((classes, FEATURES + 1))
        self.n = np.zeros((classes, FEATURES + 1))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[:, at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[:, at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, log_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = log_counts * self.idf[at]
        x = x / max(float(np.sqrt((x * x).sum())), 1e-12)
        return np.append(at, FEATURES), np.append(x, 1.0)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        at, x = self.vector(at, np.log1p(counts[at]))
        return self.weights[:, at] @ x

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(gram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequency(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all rows each hashed gram occurs, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen[:-1] += gram_counts(_text(data)) > 0
                n += 1
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["f", "n"])

    sums = rows.select(F.col(text).cast("binary").alias("b")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in sums.collect():  # one row for each feature at most
        out[r["f"]] = r["n"]
    return out[:-1], int(out[-1])


def _sample(rows: DataFrame, languages: dict[str, int]) -> list:
    """Log counts of a bounded number of rows: an equal quota of each language, by hash of doc_id and text.

    Features and logarithms take two bytes each, so the driver holds some tens of MB.
    """
    quota = max(20, SAMPLE_ROWS // max(1, len(languages)))
    space = 1 << 30
    share = {lang: space if n <= quota else max(1, space * quota // n) for lang, n in languages.items()}
    hashed = F.xxhash64("doc_id", "text")
    keep = F.lit(False)
    for lang, part in share.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(hashed, F.lit(space)) < part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"order": batch.column(0).to_pylist(), "lang": batch.column(1).to_pylist(), "f": [], "n": []}
            for data in batch.column(2).to_pylist():
                counts = gram_counts(_text(data))
                at = np.flatnonzero(counts)
                out["f"].append(at.astype(np.uint16).tobytes())
                out["n"].append(np.log1p(counts[at]).astype(np.float16).tobytes())
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    narrow = rows.filter(keep).select(F.xxhash64("doc_id", "text", F.lit(7)).alias("order"), "lang", F.col("text").cast("binary").alias("b"))
    # Ties are rows of equal text: whichever the bound leaves out, those kept are the same.
    got = narrow.mapInArrow(run, "order long, lang string, f binary, n binary").orderBy("order", "lang").limit(2 * SAMPLE_ROWS).toArrow()
    return sorted(got.to_pylist(), key=lambda r: (r["order"], r["lang"], r["f"]))


def train(docs: DataFrame, training: Column, epochs: int = 2) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) where ``training`` holds and text and lang are not null.

    Four fifths of the sample fit the weights, one fifth the temperature.
    Without usable rows the model knows no language and answers ``und``.
    More than ``MAX_LANGUAGES`` languages raise an error: weights take half a
    megabyte each on the driver, and none is dropped in silence.
    """
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = tuple(sorted(languages))
    frequency, total = document_frequency(rows)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    model = Model(names, idf, np.zeros((len(names), FEATURES + 1)), 1.0)
    if not names:
        return model
    sample = _sample(rows, languages)

    def example(r: dict) -> tuple[np.ndarray, np.ndarray, int]:
        at = np.frombuffer(r["f"], dtype=np.uint16).astype(np.int64)
        return *model.vector(at, np.frombuffer(r["n"], dtype=np.float16).astype(np.float64)), names.index(r["lang"])

    tune = [s for i, s in enumerate(sample) if i % 5 == 4]
    fit = [s for i, s in enumerate(sample) if i % 5 != 4] or sample
    ftrl = Ftrl(len(names))
    for _ in range(epochs):
        for r in fit:
            ftrl.learn(*example(r))
    weights = ftrl.weights(slice(None))
    tuned = [(weights[:, at] @ x, label) for at, x, label in map(example, tune)]
    heat = temperature(np.array([x for x, _ in tuned]).reshape(-1, len(names)), np.array([label for _, label in tuned], dtype=int))
    return Model(names, idf, weights.astype(np.float32), heat)


def predict_documents(docs: DataFrame) -> DataFrame:
    """Language of every row's whole text; rows with crc32(doc_id) mod 3 = 1 are held out from training.

    A text that is null or has no letter gets ``und`` and score 0.  Very long
    texts are counted block by block, whole.  Rows of null doc_id count as
    training rows.  One row for each row of ``docs``, repeated or not; an
    empty table gives an empty result; further columns are ignored.
    """
    model = train(docs, ~held_out("doc_id", 3, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(_text(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 3, 1).alias("held_out"), F.col("text").cast("binary").alias("b"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, unchanged, whose language is recognised with probability ``least`` or more.

    Null texts and texts without letters have no language and go; further columns pass through.
    """
    model = train(docs, ~held_out("doc_id", 3, 1))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(_text(x.as_buffer().to_pybytes() if x.is_valid else None)) for x in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and p >= least for lang, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
