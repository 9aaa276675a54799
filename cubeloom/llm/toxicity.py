"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades: 0 (not toxic) and 1 to 3. One weight vector over hashed words is shared
by all thresholds, P(grade <= k) = sigmoid(threshold_k - score), so a higher score is more severe
whatever the grade. Weights are never negative: words can make a text more severe, and a text of
unknown or harmless words scores nothing. The labels say only toxic or not; toxic training documents
are graded in thirds by how dense marking words are in them. Which words mark toxicity is found for
that on the other half of the documents, so no document's words decide its own grade.

The penalty and the decision threshold are chosen inside ``fit``, on each quarter of the labelled
documents by weights that were learnt from the others; the final weights are learnt from all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cubeloom.llm.common import lean
from cubeloom.llm.words import HashedWords, weigh

BITS = 18
GRADES = 4
#: The model is fitted on so many labelled documents at most, those with the least hashes.
TRAINING_ROWS = 12_000
#: Words are kept so that about so many would be kept if toxicity had nothing to do with words.
CHANCE_WORDS = 1.0
MIN_WORDS = 20
STEPS = 600
RATE = 0.5
#: Penalties to choose from, and the steps that each is tried with.
PENALTIES = (1e-3, 1e-2, 1e-1)
TRIAL_STEPS = 200
#: Parts that are predicted in turn from the others. Missing a toxic document costs so much more than losing another one.
FOLDS = 4
MISS_COST = 3.0
#: The threshold if there is nothing to choose it on: what the costs ask for.
DECISION = 1 / (1 + MISS_COST)


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ascending thresholds; no thresholds: nothing toxic was ever seen."""

    weights: np.ndarray
    thresholds: np.ndarray
    #: A document is toxic if a grade above 0 is at least this likely.
    decision: float = DECISION

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score, one row each."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))
        full = np.column_stack([np.zeros(len(scores)), below, np.ones(len(scores))])
        return np.diff(full, axis=1)


def ordinal_gradient(scores: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the mean negative log-likelihood by score and by threshold, and its value."""
    t = np.concatenate([[-np.inf], thresholds, [np.inf]])
    high, low = t[grade + 1] - scores, t[grade] - scores
    s = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    p_high, p_low = np.where(np.isinf(high), 1.0, s(high)), np.where(np.isinf(low), 0.0, s(low))
    p = np.maximum(p_high - p_low, 1e-12)
    d_high, d_low = p_high * (1 - p_high) / p, p_low * (1 - p_low) / p
    n = len(scores)
    by_threshold = np.zeros(len(t))
    np.add.at(by_threshold, grade + 1, -d_high / n)
    np.add.at(by_threshold, grade, d_low / n)
    return (d_high - d_low) / n, by_threshold[1:-1], float(-np.log(p).mean())


def marking_words(toxic: np.ndarray, rows: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """The words that are in toxic documents too often for chance, by a bound on the binomial tail.

    Where few pass, as with few documents, the ``MIN_WORDS`` least likely ones.
    """
    share = toxic.mean()
    seen = np.bincount(index, minlength=size)
    in_toxic = np.bincount(index, weights=toxic[rows], minlength=size)
    some = np.flatnonzero(in_toxic > share * seen)
    found = in_toxic[some] / seen[some]
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(found < 1, (1 - found) * np.log((1 - found) / (1 - share)), 0.0)
        log_tail = -seen[some] * (found * np.log(found / share) + rest)
    limit = np.log(CHANCE_WORDS / max(1, len(some)))
    limit = max(limit, np.sort(log_tail)[: MIN_WORDS][-1]) if len(some) else limit
    marks = np.zeros(size, bool)
    marks[some[log_tail <= limit]] = True
    return marks


def grade_labels(toxic: np.ndarray, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Grades 0 to 3: toxic documents in thirds, by the share of marking words in them."""
    density = np.bincount(rows, weights=value**2, minlength=len(toxic))
    cuts = np.quantile(density[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + np.searchsorted(cuts, density, side="left"), 0)


def cross_grades(toxic: np.ndarray, rows: np.ndarray, index: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Grades of documents by the words that mark toxicity in the other half of them."""
    half = np.arange(len(toxic)) % 2
    dense = np.zeros(len(index))
    for one in (0, 1):
        own = half[rows] == one
        theirs = toxic[half != one]
        if theirs.any() and not theirs.all():
            place = np.cumsum(half != one) - 1
            dense[own] = marking_words(theirs, place[rows[~own]], index[~own], size)[index[own]]
    return grade_labels(toxic, rows, value * dense)


def fit_ordinal(toxic: np.ndarray, rows: np.ndarray, index: np.ndarray, value: np.ndarray, size: int = 1 << BITS, penalty: float = PENALTIES[1], steps: int = STEPS) -> OrdinalModel:
    """Fit by gradient steps of adaptive size on sparse rows (row, index, value)."""
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(size), np.zeros(0))
    grade = cross_grades(toxic, rows, index, value, size)
    keep = marking_words(toxic, rows, index, size)[index]
    rows, index, value = rows[keep], index[keep], value[keep]
    used, at = np.unique(index, return_inverse=True)
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    share = np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / len(grade)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    tm, tv = np.zeros(len(t)), np.zeros(len(t))
    for step in range(1, steps + 1):
        scores = np.bincount(rows, weights=value * w[at], minlength=len(toxic))
        by_score, by_threshold, _ = ordinal_gradient(scores, grade, t)
        g = np.bincount(at, weights=value * by_score[rows], minlength=len(used)) + penalty * w / len(toxic)
        for x, grad, first, second in ((w, g, m, v), (t, by_threshold, tm, tv)):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            x -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        np.maximum(w, 0, out=w)
        t = np.maximum.accumulate(t + np.arange(len(t)) * 1e-6)
    weights = np.zeros(size)
    weights[used] = w
    return OrdinalModel(weights, t)


def choose(toxic: np.ndarray, rows: np.ndarray, index: np.ndarray, value: np.ndarray, size: int = 1 << BITS) -> tuple[float, float]:
    """Penalty and decision threshold, by what they do on documents that the weights were not learnt from.

    Each of ``FOLDS`` parts is predicted by weights that were learnt from the others. The penalty has the
    least log-loss of toxic against not (ties: the greatest). The threshold has the least cost; where a
    range of thresholds does, its geometric middle.
    """
    fold, best = np.arange(len(toxic)) % FOLDS, None
    if not all(toxic[fold != k].any() and not toxic[fold != k].all() for k in range(FOLDS)):
        return PENALTIES[1], DECISION
    for penalty in sorted(PENALTIES, reverse=True):
        p = np.zeros(len(toxic))
        for k in range(FOLDS):
            aside = fold == k
            place, own = np.where(aside, np.cumsum(aside), np.cumsum(~aside)) - 1, aside[rows]
            model = fit_ordinal(toxic[~aside], place[rows[~own]], index[~own], value[~own], size, penalty, TRIAL_STEPS)
            scores = np.bincount(place[rows[own]], weights=value[own] * model.weights[index[own]], minlength=int(aside.sum()))
            p[aside] = np.clip(1 - model.grades(scores)[:, 0], 1e-9, 1 - 1e-9)
        loss = -np.log(np.where(toxic, p, 1 - p)).mean()
        if best is None or loss < best[0]:
            best = (loss, penalty, p)
    _, penalty, p = best
    order = np.argsort(p, kind="stable")
    p, bad = p[order], toxic[order]
    # A threshold between two neighbours: the bad ones below are missed, the others above are lost.
    cost = MISS_COST * np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([np.cumsum(~bad[::-1])[::-1], [0]])
    low, high = np.concatenate([[1e-9], p]), np.concatenate([p, [1.0]])
    cost[low == high] = np.inf
    least = np.flatnonzero(cost == cost.min())
    return penalty, float(np.sqrt(low[least[0]] * high[least[-1]]))


_FEATURES = "doc_id long, toxic boolean, index array<int>, value array<float>"


@lean
def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = HashedWords(BITS)
    for batch in batches:
        found = [words.features(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
            ["doc_id", "toxic", "index", "value"],
        )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> OrdinalModel:
    """Fit on the labelled documents with the least hashes of doc_id, ``max_rows`` at most.

    Rows without a label, a doc_id or a text are not learnt from; a document with several labels is
    toxic if one says so. Texts with the same words, of one doc_id or several, count once (copies would
    make each of their words look telling), as toxic if one is. ``max_rows`` come to the driver at most:
    the first by hash of doc_id and by words, however rows are dealt. Whole texts count, however long.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # chosen: max_rows, 9 bytes each
    distinct = sample.mapInArrow(_features, _FEATURES).groupBy("index", "value").agg(F.max("toxic").alias("toxic"), F.min(F.xxhash64("doc_id")).alias("place"))
    found = distinct.orderBy("place", "index", "value").limit(max_rows).select("toxic", "index", "value").toArrow().combine_chunks()
    if not found.num_rows:
        return OrdinalModel(np.zeros(1 << BITS), np.zeros(0))
    lists = found["index"].combine_chunks()
    rows = np.repeat(np.arange(found.num_rows), np.diff(lists.offsets.to_numpy()))
    index = lists.flatten().to_numpy().astype(np.int64)
    value = found["value"].combine_chunks().flatten().to_numpy().astype(np.float64)
    toxic = found["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    penalty, decision = choose(toxic, rows, index, value)
    return replace(fit_ordinal(toxic, rows, index, value, penalty=penalty), decision=decision)


_SCORES = "toxic boolean, grade int, expected_severity double, p_toxic double"


def score_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with toxic, grade (the likeliest), expected_severity (0 to 3) and p_toxic.

    ``docs`` needs ``text``; every row and column stays, but columns with those four names are
    replaced. A null or empty text, or one without words, is scored by the thresholds alone. Whole
    texts count, however long. Of equally likely grades the lowest is taken; a document exactly at the
    decision threshold is toxic. Equal texts get equal results; no documents give no rows.
    """
    names = [c.split()[0] for c in _SCORES.split(", ")]
    docs = docs.drop(*names)
    at = docs.columns.index("text")
    used = np.flatnonzero(model.weights)
    weights, thresholds, decision = model.weights[used], model.thresholds, model.decision

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = HashedWords(BITS)
        weight = np.zeros(1 << BITS)
        weight[used] = weights
        own = OrdinalModel(weight, thresholds)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for k, cell in enumerate(batch.column(at)):
                index = words.indices(cell.as_py())
                some, count = np.unique(index[weight[index] != 0], return_counts=True)
                scores[k] = weigh(count, len(index)) @ weight[some]
            p = own.grades(scores) if len(thresholds) else np.tile([1.0, 0, 0, 0], (batch.num_rows, 1))
            grade = p.argmax(axis=1)
            severity = p @ np.arange(p.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 - p[:, 0] >= decision), pa.array(grade, pa.int32()), pa.array(severity), pa.array(1 - p[:, 0])], names=[*batch.schema.names, *names]
            )

    return docs.mapInArrow(run, StructType([*docs.schema, *StructType.fromDDL(_SCORES)]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all columns they came with, whatever their names.

    Null and empty texts stay. Repeated rows stay or go together; no documents give no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return score_documents(whole, fit(docs, labels)).filter("not toxic").select("row.*")
