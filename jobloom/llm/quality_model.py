"""Quality classifier: a generalised additive model with pairwise interactions.

Measures of a text are binned. Boosting goes round the features; each step fits a shallow
tree to the gradients of one feature's bins and adds it to that feature's lookup table.
Then the pairs whose quadrants explain most of what is left are boosted alike, into
tables of two features. A score is a sum of looked-up bins.

Fitting sees at most ``MAX_TRAIN`` labelled rows, of which only measures reach the driver.
Scoring is one pass over the whole texts, without a shuffle; the model is a few kilobytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.quality_rules import STOP_WORDS
from jobloom.llm.sampling import held_out
from jobloom.llm.tables import map_rows, table

MODULUS, HELD_OUT = 3, 1
MAX_TRAIN = 8000  # bound of the training sample
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 6, 0.1
LAMBDA = 1.0

FEATURES = ["n_words", "word_chars", "symbol_ratio", "mark_ratio", "upper_ratio", "digit_ratio", "unique_ratio", "same_next_ratio", "stop_ratio", "dup_line_ratio", "line_words", "comma_ratio"]

_STOP = frozenset(STOP_WORDS)
_SYMBOLS = re.compile(r"[#*$%&|<>~^=_{}\[\]\\]")
_DIGITS = re.compile(r"[0-9]")


def measures(text: str | None) -> list[float]:
    """The features of a whole text; all 0 for null and empty texts."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    low = [w.lower() for w in words]
    chars = sum(map(len, words))
    return [
        float(np.log1p(n)), chars / n, len(_SYMBOLS.findall(text)) / n, (text.count("!") + text.count("?")) / n,
        sum(map(str.isupper, words)) / n, len(_DIGITS.findall(text)) / chars, len(set(low)) / n,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, sum(map(_STOP.__contains__, low)) / n,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), text.count(",") / n,
    ]


def _leaf(g: float, h: float) -> float:
    return -g / (h + LAMBDA)


def _gain(g, h):
    return g * g / (h + LAMBDA)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """What a tree of this depth adds to each bin, from gradients and curvatures by bin."""
    n = len(g)
    if depth and n > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)
        at = int(gains.argmax()) + 1
        if gains[at - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(n, _leaf(g.sum(), h.sum()))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain of the best cut of a table of two features into quadrants, and what they add."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = np.s_[:-1, :-1], (-1, -1)
    parts = []
    for c in (cg, ch):
        nw = c[a]
        ne, sw = c[:-1, -1:] - nw, c[-1:, :-1] - nw
        parts.append((nw, ne, sw, c[b] - nw - ne - sw))
    gains = sum(_gain(x, y) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    leaf = [_leaf(float(x[i, j]), float(y[i, j])) for x, y in zip(*parts, strict=True)]
    add = np.empty_like(g)
    add[: i + 1, : j + 1], add[: i + 1, j + 1 :], add[i + 1 :, : j + 1], add[i + 1 :, j + 1 :] = leaf
    return float(gains[i, j] - _gain(cg[b], ch[b])), add


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[b[i]]
        for i, j, t in self.pairs:
            z += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of measures ``x`` and labels ``y`` (0 or 1). With one class or no rows it is constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    b, z = model.bins(x), np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i, s in enumerate(sizes):
            g, h = slopes()
            add = RATE * _tree(np.bincount(b[i], g, s), np.bincount(b[i], h, s), 2)
            model.tables[i] += add
            z += add[b[i]]

    def grids(i, j):
        g, h = slopes()
        at, shape = b[i] * sizes[j] + b[j], (sizes[i], sizes[j])
        return [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    cuts = [(i, j) for i in range(len(sizes)) for j in range(i) if min(sizes[i], sizes[j]) > 1]
    best = sorted(cuts, key=lambda ij: -_quadrants(*grids(*ij))[0])[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in best]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            add = RATE * _quadrants(*grids(i, j))[1]
            t += add
            z += add[b[i], b[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """A model from rows of ``labels`` that are not held out, joined to their texts.

    The sample is the first ``max_train`` labels by the hash of the doc_id. Null labels and
    doc_ids without a row are left out; of several labels of one document the largest holds; of
    several rows of one document the one with the least measures counts, so no more than
    ``max_train`` rows reach the driver.
    """
    few = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, HELD_OUT))
    few = few.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "label")  # max_train rows

    def measured(batches):
        for batch in batches:
            x = pa.array([measures(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), x], names=["doc_id", "label", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(measured, f"doc_id {kind}, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x")).toArrow()
    data = sorted(zip(found.column("doc_id").to_pylist(), found.column("label").to_pylist(), found.column("x").to_pylist(), strict=True))
    x = np.array([d[2] for d in data], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([d[1] for d in data], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    The score is between 0 and 1, higher where label 1 is likelier; predicted is 1 from
    0.5 on. Null and empty texts are scored as texts without words. Repeated rows are
    each scored; an empty table gives no rows; other columns are ignored.
    """

    def scored(batches):
        for batch in batches:
            x = np.array([measures(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            p = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model predicts as 1. Null and empty
    texts are judged as texts without words; an empty table gives no rows."""

    def kept(batches):
        for batch in batches:
            x = np.array([measures(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return map_rows(docs, kept)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
