"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted over whole texts in one pass. The trees are grown on a bounded sample of
labelled documents, with splits on binned statistics and monotonic constraints (more symbols, more
repeated lines or words never make a document better), then flattened into node arrays that score a
whole batch at once. Two fixed base rules come before the trees.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import lean, stage

#: Fixed values of the base rules.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "unique_share", "echo_share", "upper_share", "digit_share", "mark_share", "words_per_line", "long_share")
#: -1: more of it is never better.
MONOTONIC = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "echo_share": -1}

TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 3, 64, 0.2
MIN_CHILD, PENALTY = 5.0, 1.0
DECISION = 0.5


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of so many words that are found twice or more, the first included."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    s = h[:n].copy()
    for i in range(1, window):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[i : n + i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.sort(s)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(s, twice))
    change = np.zeros(len(h) + 1, np.int64)
    change[at] += 1
    change[at + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the trees' features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_dup = len(lines) - len(set(lines))
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)  # compared within this text only
    n_repeat = repeated_words(h)
    per_word, per_char = max(1, n), max(1, word_chars)
    upper = len(raw) - len(raw.translate(None, string.ascii_uppercase.encode()))
    digits = len(raw) - len(raw.translate(None, string.digits.encode()))
    marks = len(raw) - len(raw.translate(None, b".,;:!?"))
    features = [
        float(np.log1p(n)),
        word_chars / per_word,
        n_symbols / per_char,
        n_dup / max(1, len(lines)),
        n_repeat / per_word,
        len(set(words)) / per_word,
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        upper / per_char,
        digits / per_char,
        marks / per_char,
        n / max(1, len(lines)),
        sum(map((20).__lt__, map(len, words))) / per_word,
    ]
    return n, word_chars, n_symbols, n_dup, n_repeat, features


_STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def count_statistics(docs: DataFrame) -> DataFrame:
    """The statistics of every whole text; a null text counts as empty."""
    names = [c.split()[0] for c in _STATISTICS.split(", ")]

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _STATISTICS)


@dataclass(frozen=True)
class Forest:
    """Trees as node arrays, one row per tree: feature (-1: leaf), threshold, left and right child, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x: all rows go down all trees together, a level at a time."""
        n_trees = len(self.feature)
        if not n_trees:
            return np.full(len(x), self.bias)
        tree, row = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            down = np.where(x[row, np.maximum(f, 0)] <= self.threshold[tree, node], self.left[tree, node], self.right[tree, node])
            node = np.where(f < 0, node, down)
        return self.bias + self.value[tree, node].sum(axis=1)


class _Tree:
    """One tree over binned rows, grown level by level within value bounds that keep it monotonic."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, signs: np.ndarray, depth: int):
        self.bins, self.edges, self.g, self.h, self.signs = bins, edges, gradient, hessian, signs
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self._grow(np.arange(len(bins)), depth, -np.inf, np.inf)

    def _grow(self, rows: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(self.feature)
        g, h = self.g[rows].sum(), self.h[rows].sum()
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, me), (self.right, me), (self.value, float(np.clip(-g / (h + PENALTY), low, high)))):
            column.append(x)
        found = self._split(rows, g, h, low, high) if depth else None
        if found:
            f, b, mid = found
            goes = self.bins[rows, f] <= b
            self.feature[me], self.threshold[me] = f, float(self.edges[f][b])
            s = self.signs[f]
            self.left[me] = self._grow(rows[goes], depth - 1, mid if s < 0 else low, mid if s > 0 else high)
            self.right[me] = self._grow(rows[~goes], depth - 1, mid if s > 0 else low, mid if s < 0 else high)
        return me

    def _split(self, rows: np.ndarray, g: float, h: float, low: float, high: float) -> tuple[int, int, float] | None:
        best, gain = None, 1e-6
        for f in range(self.bins.shape[1]):
            size = len(self.edges[f])
            if not size:
                continue
            b = self.bins[rows, f]
            gl = np.cumsum(np.bincount(b, self.g[rows], size + 1))[:size]
            hl = np.cumsum(np.bincount(b, self.h[rows], size + 1))[:size]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(-gl / (hl + PENALTY), low, high), np.clip(-gr / (hr + PENALTY), low, high)
            gains = -(gl * vl + (hl + PENALTY) * vl**2 / 2) - (gr * vr + (hr + PENALTY) * vr**2 / 2)
            whole = np.clip(-g / (h + PENALTY), low, high)
            gains += g * whole + (h + PENALTY) * whole**2 / 2
            gains[(hl < MIN_CHILD / 4) | (hr < MIN_CHILD / 4) | (self.signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(np.argmax(gains))
            if gains[k] > gain:
                best, gain = (f, k, float((vl[k] + vr[k]) / 2)), gains[k]
        return best


def fit_forest(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees for the log-odds of y. One class alone, or no rows: the share of it as a constant."""
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    empty = np.zeros((0, 1))
    if not len(y) or y.all() or not y.any():
        return Forest(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, bias, 0)
    edges = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges.append(cuts[cuts < column.max()])
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    score, grown = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = _Tree(bins, edges, p - y, p * (1 - p), signs, depth)
        one = flatten([t], 0.0, depth)
        score += RATE * one.score(x)
        t.value = [RATE * v for v in t.value]
        grown.append(t)
    return flatten(grown, bias, depth)


def flatten(trees: list[_Tree], bias: float, depth: int) -> Forest:
    size = max(len(t.feature) for t in trees)
    pad = lambda name, kind: np.array([[*getattr(t, name), *[0] * (size - len(t.feature))] for t in trees], kind)
    return Forest(pad("feature", int), pad("threshold", float), pad("left", int), pad("right", int), pad("value", float), bias, depth)


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> Forest:
    """Fit on the labelled documents with the least hashes of doc_id, ``max_rows`` at most.

    A document with several labels is good if all say so; rows without label or doc_id are left out.
    Rows of one doc_id with equal statistics count once, and ``max_rows`` come to the driver at most:
    the first by hash of doc_id and statistics, however rows are dealt.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = stats.select("doc_id", "features").join(F.broadcast(chosen), "doc_id").distinct()  # chosen: max_rows, 9 bytes each
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_rows).toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    signs = np.array([MONOTONIC.get(f, 0) for f in FEATURES])
    return fit_forest(x, np.array(rows["quality"].to_pylist(), float) > 0, signs)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(stats: DataFrame, forest: Forest) -> DataFrame:
    """The statistics with base_failed, quality (0 to 1) and kept."""

    @F.pandas_udf("double")
    def score(features):
        import pandas as pd

        x = np.array(features.tolist(), float).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-forest.score(x))))

    judged = stats.withColumn("base_failed", base_failed()).withColumn("quality", score("features"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= DECISION)).drop("features")


def rate_documents(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """Per document its counts, base_failed, quality and kept.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and ``quality``; other columns
    are not read, whatever their names. A null text has no words and fails the base rules, as does an
    empty one; whole texts count, however long. A quality of exactly ``DECISION`` is kept. Repeated
    rows are rated alike; no documents give no rows; without labels the base rules decide alone.
    """
    stats = stage(count_statistics(docs), "statistics")
    return judge(stats, fit(stats, labels, max_rows))
