"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins, and boosting goes round the features
time and again: a shallow tree over one feature's bins is fitted to the present
residuals and added, shrunk, to that feature's lookup table.  Then the pairs of
features whose joint residuals gain most get tables of their own in the same
way.  A text's score is the logistic of an intercept plus one number from each
table, so scoring is a look-up and an addition for each feature and pair.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, the
smallest by a hash of the identifier); every text is scored, whole.

Cases: a null text counts as empty, and an empty text is scored like any other.
Labels that are null are left out; with none left, or with one class only, the
score is the (smoothed) share of label 1.  Null identifiers and repeated rows
are scored like any other.  Other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.shared import table, text_of

#: Labelled rows that the fit takes at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 12
RATE, RIDGE, SPLITS, LEAST = 0.15, 2.0, 2, 12

FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next", "upper", "digits", "marks",
    "bars", "exclaims", "stops", "commas", "blanks", "other_bytes", "lines", "distinct_lines", "top_line", "shouted_words", "marked_words",
)


def features(text: str) -> tuple[float, ...]:
    """Numbers that describe a text, in the order of FEATURES."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    byte = np.bincount(raw, minlength=256)
    words = text.split()
    n = max(1, len(words))
    size = max(1, len(raw))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    line_counts: dict[str, int] = {}
    for x in lines:
        line_counts[x] = line_counts.get(x, 0) + 1
    repeated = sum(map(operator.eq, words, words[1:]))
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    marks = int(byte[[35, 36, 37, 38, 42, 64, 94, 95, 126, 60, 62, 61, 43]].sum())
    shouted = sum(map(str.isupper, words))
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?)'\"")
    return (
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        float(np.log1p(max(map(len, words), default=0))),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        repeated / n,
        upper / max(1, upper + lower),
        int(byte[48:58].sum()) / size,
        marks / size,
        int(byte[124]) / n,
        int(byte[33]) / n,
        int(byte[46]) / n,
        int(byte[44]) / n,
        (int(byte[32]) + int(byte[9])) / size,
        int(byte[128:].sum()) / size,
        len(lines) / n,
        len(line_counts) / max(1, len(lines)),
        max(line_counts.values(), default=0) / max(1, len(lines)),
        shouted / n,
        marked / n,
    )


@dataclass
class Model:
    """Lookup tables over bins; ``edges[j]`` are the upper bounds of feature j's bins but the last."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, shape) in enumerate(zip(self.edges, self.tables)):
            total += shape[np.searchsorted(edges, x[:, j])]
        for (j, k), shape in zip(self.pairs, self.pair_tables):
            total += shape[np.searchsorted(self.pair_edges[j], x[:, j]), np.searchsorted(self.pair_edges[k], x[:, k])]
        return _logistic(total)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts at quantiles of the values, and of those other than the commonest one."""
    cuts = [np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")]
    values, counts = np.unique(x, return_counts=True)
    rest = x[x != values[counts.argmax()]]
    if len(rest):
        cuts.append(np.quantile(rest, np.linspace(0, 1, bins // 2 + 1)[1:-1], method="lower"))
        cuts.append(values[counts.argmax()][None])
    return np.unique(np.concatenate(cuts))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of SPLITS splits, grown by gain."""
    leaves = [(0, len(g))]
    for _ in range(SPLITS):
        best = (1e-9, None, None)
        for a, b in leaves:
            if b - a < 2:
                continue
            gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
            gt, ht, nt = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gains = np.where((nl >= LEAST) & (nt - nl >= LEAST), _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht), 0)
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (gains[at], (a, b), a + at + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of two features once."""
    total = [x.sum() for x in (g, h, n)]
    corner = [x.cumsum(0).cumsum(1) for x in (g, h, n)]
    parts = []
    for c, t in zip(corner, total):
        ll = c[:-1, :-1]
        lh, hl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
        parts.append((ll, lh, hl, t - ll - lh - hl))
    gains = sum(np.where(nn >= LEAST, _gain(gg, hh), 0) for gg, hh, nn in zip(*parts))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros(g.shape)
    for gg, hh, nn, rows, cols in zip(*parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        if nn[i, j] >= LEAST:
            out[rows, cols] = gg[i, j] / (hh[i, j] + RIDGE)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model from features (rows by features) and labels 0 or 1."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(base / (1 - base))))
    if not len(y) or y.min() == y.max():
        return model
    y = y.astype(float)
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    logit = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = _logistic(logit)
            m = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, y - p, m), np.bincount(b, p * (1 - p), m), sizes[j])
            model.tables[j] += step
            logit += step[b]
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grids(j: int, k: int) -> list[np.ndarray]:
        cell = coarse[j] * width[k] + coarse[k]
        p = _logistic(logit)
        return [np.bincount(cell, w, width[j] * width[k]).reshape(width[j], width[k]) for w in (y - p, p * (1 - p), None)]

    able = [j for j in range(x.shape[1]) if width[j] > 1]
    ranked = sorted(((_quadrants(*grids(j, k))[0], j, k) for i, j in enumerate(able) for k in able[i + 1 :]), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(j, k) for _, j, k in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((width[j], width[k])) for j, k in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (j, k), shape in zip(model.pairs, model.pair_tables):
            step = RATE * _quadrants(*grids(j, k))[1]
            shape += step
            logit += step[coarse[j], coarse[k]]
    return model


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of the identifier as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).alias("label"))
    # the sample's bound is the parameter, so it may be broadcast
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    found = rows.select("id", "label", "text").mapInArrow(run, "id long, label boolean, x array<double>").toPandas()
    if not len(found):
        return Model(0.0)
    x = np.array(found["x"].tolist()).reshape(len(found), len(FEATURES))
    order = np.lexsort([*x.T, found["label"].to_numpy(), found["id"].to_numpy()])  # the same model whatever order rows come in
    return fit(x[order], found["label"].to_numpy()[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(_matrix(part.column(1).to_pylist())))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        parts = [model.score(_matrix(texts.iloc[a : a + 1024].tolist())) >= threshold for a in range(0, len(texts), 1024)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    # only texts go to Python, and a verdict comes back: the rows stay where they are
    return docs.where(good(text_of(text_col)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
