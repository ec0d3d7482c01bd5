"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is binned; the model is one lookup table for each feature and one for each of
a few chosen pairs. Tables are learnt by cyclic boosting: in turn for each feature a shallow
tree (at most three leaves over that feature's bins) is fitted to the gradient of the
logistic loss and added to its table at a small rate. Pairs are then ranked by how much a
tree of four quadrants would still gain, and the best are boosted in the same way. A text is
scored by adding its bins' entries, for whole batches at once.

The labelled rows to learn from are bounded: at most `max_rows`, those whose hashed id is
smallest (of rows with one id the one whose features come first). Features are counted over whole texts of all rows.

Defined cases: a null or empty text has zero for every feature and is scored like any other.
Without labels every score is 0.5; with one class only, scores are that class's smoothed share. Null or
contradicting labels and labels with a null id are left out. A row with a null id is scored
and not held out. Repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.batches import id_and_text, map_texts, python_stage, remainder
from foliant.llm.rules import statistics
from foliant.llm.storage import materialise

FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "repeat_share", "echo_share", "dup_line_share", "distinct_share", "digit_share", "stop_share", "comma_share", "line_words", "other_share")
#: Labelled rows to learn from at most.
MAX_ROWS = 20_000
BINS = 24
ROUNDS, RATE, SMOOTH = 150, 0.15, 5.0
PAIRS, PAIR_ROUNDS = 4, 40

_DIGITS = b"0123456789"


def features(text: str) -> tuple[float, ...]:
    """The FEATURES of one text."""
    n, chars, symbols, dup_lines, repeat, lines, upper, letters, echo = statistics(text)
    raw = text.encode("utf-8", "surrogatepass")
    share = lambda a, b: a / b if b else 0.0
    return (
        float(np.log1p(n)),
        share(chars, n),
        share(symbols, chars),
        share(upper, letters),
        share(repeat, n),
        share(echo, n),
        share(dup_lines, lines),
        share(len(set(raw.split())), n),
        share(len(raw) - len(raw.translate(None, _DIGITS)), chars),
        share(raw.count(b".") + raw.count(b"!") + raw.count(b"?"), n),
        share(raw.count(b",") + raw.count(b";"), n),
        share(n, lines),
        share(raw.count(b"@") + raw.count(b"+") + raw.count(b"=") + raw.count(b"/") + raw.count(b"_"), chars),
    )


def _grow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the tree with at most three leaves that gains most; g, h: gradient and curvature by bin."""
    leaf = lambda a, b: a.sum() / (b.sum() + SMOOTH)
    cuts: list[int] = [0, len(g)]
    for _ in range(2):
        best, at = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            left, right = cg[:-1] ** 2 / (ch[:-1] + SMOOTH), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + SMOOTH)
            gain = left + right - cg[-1] ** 2 / (ch[-1] + SMOOTH)
            if gain.max() > best:
                best, at = gain.max(), lo + 1 + int(gain.argmax())
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = leaf(g[lo:hi], h[lo:hi])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a = cg[:-1, :-1], ch[:-1, :-1]
    b = cg[:-1, -1:] - a[0], ch[:-1, -1:] - a[1]
    c = cg[-1:, :-1] - a[0], ch[-1:, :-1] - a[1]
    d = cg[-1, -1] - a[0] - b[0] - c[0], ch[-1, -1] - a[1] - b[1] - c[1]
    gain = sum(x**2 / (y + SMOOTH) for x, y in (a, b, c, d))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty(g.shape)
    for rows, cols, (x, y) in ((slice(0, i + 1), slice(0, j + 1), a), (slice(0, i + 1), slice(j + 1, None), b), (slice(i + 1, None), slice(0, j + 1), c), (slice(i + 1, None), slice(j + 1, None), d)):
        out[rows, cols] = x[i, j] / (y[i, j] + SMOOTH)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + SMOOTH)), out


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[b[:, j]]
            for (j, k), t in self.pairs.items():
                total += t[b[:, j], b[:, k]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables on rows of features and labels 0 or 1."""
    n, positive = len(y), float(np.sum(y))
    if not n:
        return Model()
    share = (positive + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))))
    if positive in (0, n):
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    b = model.bins(x)
    total = np.full(n, model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = slope()
            step = RATE * _grow(np.bincount(b[:, j], g, sizes[j]), np.bincount(b[:, j], h, sizes[j]))
            t += step
            total += step[b[:, j]]
    cell = lambda j, k, v: np.bincount(b[:, j] * sizes[k] + b[:, k], v, sizes[j] * sizes[k]).reshape(sizes[j], sizes[k])
    g, h = slope()
    gains = sorted(((_quadrants(cell(j, k, g), cell(j, k, h))[0], j, k) for j, k in combinations(range(len(sizes)), 2) if min(sizes[j], sizes[k]) > 1), reverse=True)
    model.pairs = {(j, k): np.zeros((sizes[j], sizes[k])) for _, j, k in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (j, k), t in model.pairs.items():
            g, h = slope()
            step = RATE * _quadrants(cell(j, k, g), cell(j, k, h))[1]
            t += step
            total += step[b[:, j], b[:, k]]
    return model


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features as an array; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return map_texts(id_and_text(docs, id_col, text_col), "text", run, "doc_id long, features array<double>")


def agreed_labels(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, y) for each id whose labels agree."""
    return labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(column).alias("y"), F.max(column).alias("__y")).filter("doc_id is not null and y = __y and y in (0, 1)").select("doc_id", "y")


def smallest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of doc_id (fewer only if there are fewer, or by a chance that is next to none).

    A threshold from a count leaves each task about twice its share, so that no task sorts or sends `most` rows of its own."""
    hashed = rows.withColumn("__h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    n = rows.count()
    if n > 4 * most:
        hashed = hashed.filter(F.col("__h") < int((2 * most + 100) / n * (1 << 40)))
    return hashed.orderBy("__h", "doc_id").limit(most).drop("__h")


def fit(featured: DataFrame, labels: DataFrame, learn: Column, column: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learns from the labelled rows for which `learn` (an expression over doc_id) holds."""
    rows = featured.join(agreed_labels(labels, column).filter(learn), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.first("y").alias("y"))
    rows = smallest_hashes(materialise(rows, "labelled"), max_rows).toPandas()
    return train(np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, column: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows with crc32(doc_id) mod `modulus` = `held` are never learnt from."""
    featured = materialise(with_features(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(featured, labels, remainder("doc_id", modulus) != held, column, max_rows))

    def run(batches):
        for batch in batches:
            flat = batch.column("features")
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    scored = python_stage(featured, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", "predicted")
