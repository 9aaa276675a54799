"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three letters (a word's edges included) are hashed; document frequencies are counted
over all training documents. The weights are learnt on a bounded sample by follow-the-regularised-
leader with elastic-net penalties, which leaves useless n-grams at exactly zero. Probabilities are
then calibrated by a temperature found on sample documents that the weights were not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import lean

BITS = 15
SIZE = 1 << BITS
#: Weights are learnt on so many documents at most, those with the least hashes.
TRAINING_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
#: One sample document in so many is for calibration only.
CALIBRATION = 5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def ngrams(text: str) -> np.ndarray:
    """Hashes of all runs of one to three characters; what is no letter counts as one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first stays
    keep[0] = True
    x = np.where(letter, points, 32)[keep].astype(np.uint32)
    k = np.uint32(0x9E3779B1)
    two = x[:-1] * k + x[1:]
    three = two[:-1] * k + x[2:]
    shift = np.uint32(32 - BITS)
    grams = [x[x != 32] * np.uint32(0x85EBCA6B), two * np.uint32(0xC2B2AE35), three * np.uint32(0x27D4EB2F)]
    mixed = [(g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for g in grams]
    return np.concatenate(mixed)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.bincount(ngrams(text), minlength=SIZE)
    some = np.flatnonzero(c)
    return some, c[some]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # one row per n-gram, one column per language
    bias: np.ndarray
    temperature: float

    def vector(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count) * self.idf[index]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` and 0 without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        index, count = counts(text)
        p = softmax((self.vector(index, count) @ self.weights[index] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader-proximal with L1 and L2 penalties.

    Each row is (index, value). Rows come in the given order in each epoch.
    """
    z, n = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def weights(at):
        free = np.abs(z[at]) - L1
        return np.where(free > 0, -np.sign(z[at]) * free / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for (index, value), k in zip(rows, y, strict=True):
            at, v = np.append(index, SIZE), np.append(value, 1.0)  # the last weight is the bias
            w = weights(at)
            error = softmax(v @ w)
            error[k] -= 1
            g = v[:, None] * error[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(np.arange(SIZE + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section over its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(log_t):
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out():
    """Whether crc32 of the doc_id as text leaves 2 modulo 4; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@lean
def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SIZE, np.int64)
    n = 0
    for batch in batches:
        for cell in batch.column(0):
            seen += np.bincount(ngrams(cell.as_py()), minlength=SIZE) > 0
            n += 1
    if n:
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(np.append(some, SIZE), pa.int32()), "n": pa.array(np.append(seen[some], n), pa.int64())})


@lean
def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))],
            ["lang", "place", "index", "count"],
        )


def fit(docs: DataFrame, max_rows: int = TRAINING_ROWS) -> LanguageModel:
    """Learn from documents that are not held out and have a language and a text.

    Document frequencies cover all of them, weights and temperature the ``max_rows`` doc_ids of least
    hash. Of their rows, equal ones (doc_id, language and n-grams) count once, and ``max_rows`` come to
    the driver at most: the first by hash of doc_id, language and n-grams, however rows are dealt.
    Whole texts count, however long; nothing to learn from gives a model without languages.
    """
    known = docs.filter(~held_out()).filter("lang is not null and text is not null")
    frequency = known.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # SIZE + 1 rows at most
    df = np.zeros(SIZE + 1)
    df[frequency["gram"].to_numpy()] = frequency["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    if not df[-1]:
        return LanguageModel([], idf, np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    place = F.xxhash64("doc_id")
    last = least_hashes(known.select(place.alias("place")), max_rows, int(df[-1]))
    sample = known.select("lang", "text", place.alias("place")).filter(F.col("place") <= last)
    found = sample.mapInArrow(_counts, "lang string, place long, index array<int>, count array<int>")
    rows = found.distinct().orderBy("place", "lang", "index", "count").limit(max_rows).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    y = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    model = LanguageModel(languages, idf, np.zeros((SIZE, len(languages))), np.zeros(len(languages)), 1.0)
    vectors = []
    for index, count in zip(rows["index"], rows["count"], strict=True):
        index, count = index.values.to_numpy(), count.values.to_numpy()
        vectors.append((index, model.vector(index, count)))
    aside = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    weights, bias = fit_ftrl([v for v, a in zip(vectors, aside, strict=True) if not a], y[~aside], len(languages))
    logits = np.array([v @ weights[i] + bias for (i, v), a in zip(vectors, aside, strict=True) if a]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, y[aside]))


def least_hashes(places: DataFrame, n: int, n_rows: int) -> int:
    """The ``n``-th least distinct hash of a column ``place``, or the greatest.

    Only hashes below a limit are looked at, so the table is not ordered; where repeated rows leave too
    few of them the limit is raised.
    """
    share = min(1.0, 2 * n / n_rows)
    while True:
        limit = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
        found = places.filter(F.col("place") <= limit).distinct().orderBy("place").limit(n).agg(F.max("place").alias("last"), F.count("*").alias("n")).first()
        if found.n == n or share == 1.0:
            return found.last
        share = min(1.0, share * 8)


_PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double"


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score.

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0, as is
    every text if there was nothing to learn from. Of equally likely languages the first by name is
    taken. Whole texts count, however long. Repeated rows are predicted alike; a null doc_id is
    returned as such; other columns are not read, whatever their names; no documents give no rows.
    """

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, _PREDICTIONS)
