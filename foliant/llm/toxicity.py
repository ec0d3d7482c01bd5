"""Toxicity: a linear classifier over character n-grams with naive Bayes features.

A feature is log2(1 + the number of different words in a text that hold a character n-gram),
words being lower-cased and padded with spaces. Each is scaled by its naive Bayes log-count ratio, log((pos + 1) / (P + 2)) -
log((neg + 1) / (N + 2)), of the texts that hold it among the P toxic and N other ones learnt from, and a logistic
regression with an L2 penalty is fitted on the scaled features. Only n-grams whose share
differs between the classes by at least MIN_Z standard errors are kept, MAX_GRAMS at most, so
that long clean texts gather no weight from noise.

The labelled rows to learn from are bounded: at most `max_rows` of each class, those whose
hashed id is smallest. N-gram counts of these are summed by Spark. Every text is scored whole:
the different words of many texts are looked up together in a bounded table of each worker process, which
holds the known n-grams of each word.

Defined cases: a null or empty text has no n-grams and scores like any text without known
ones. Without labels every score is 0.5; with one class only, that class's smoothed share. Null or contradicting labels are
left out. A row with a null id is scored and not held out. Repeated rows are each scored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm import words as W
from foliant.llm.batches import id_and_text, kept, map_texts, remainder, texts_of
from foliant.llm.gam import agreed_labels, smallest_hashes
from foliant.llm.storage import materialise

#: Labelled rows to learn from at most, of each class.
MAX_ROWS = 3_000
#: Tasks that the labelled texts are dealt out to.
SAMPLE_TASKS = 16
SIZES = (3, 4, 5, 6, 7)
MAX_GRAMS = 20_000
MIN_Z = 4.0
MIN_TEXTS = 3
PENALTY = 1e-5
#: Steps of the fit at most, the relative decrease of the loss at which it has converged, and the steps that it remembers.
STEPS, CONVERGED, MEMORY = 500, 1e-6, 10
#: Words that a worker keeps; beyond, half of them go, those not used for longest.
CACHE = 200_000

_WORDS = re.compile(r"\w+").findall


def grams(word: str) -> set[str]:
    """The n-grams of a word with a space on either side; of a long word too."""
    padded = f" {word} "
    return {padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)}


def words_of(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def held(texts: list[str], number: dict[str, int], new: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the numbers of its n-grams, ascending, and how many of its words hold each; unknown n-grams get a number or are passed over."""
    of: dict[str, np.ndarray] = {}
    for text in texts:
        for w in (words := words_of(text)):
            if w not in of:
                of[w] = np.array([number.setdefault(g, len(number)) for g in grams(w)] if new else [number[g] for g in grams(w) if g in number], np.int64)
        yield np.unique(np.concatenate([np.empty(0, np.int64), *map(of.__getitem__, words)]), return_counts=True)


@dataclass
class Model:
    bias: float = 0.0
    #: Weight, times log-count ratio, of each n-gram.
    weight: dict[str, float] = field(default_factory=dict)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """A model and the words of one worker process."""

    def __init__(self, model: Model):
        self.bias, self.number = model.bias, {g: k for k, g in enumerate(model.weight)}
        self.weight = np.array(list(model.weight.values()), float)
        word = re.compile(r"\w").match
        self.classes = W.class_table(lambda c: W.LETTER if word(c) else W.OTHER)
        self.table, self.grams = W.WordTable(CACHE), W.Payload(np.int32)

    def known(self, word: str) -> list[int]:
        return sorted(self.number[g] for g in grams(word) if g in self.number)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability that each text is toxic."""
        n, total = len(self.weight), np.full(len(texts), self.bias)
        if n and texts:
            kept = self.table.prune()
            if kept is not None:
                self.grams.keep(kept)
            batch = W.Batch([t.lower().encode("utf-8", "surrogatepass") for t in texts], self.classes)
            flags = batch.unsure()
            first, size, counts = batch.words(W.class_runs(batch), flags)
            owner = np.repeat(np.arange(len(texts)), counts)
            word = batch.cls[first] == W.LETTER
            slots, new = self.table.place(batch, first[word], size[word])
            found = [self.known(w.decode("utf-8", "surrogatepass")) for w in new]
            self.grams.append(np.array([g for f in found for g in f], np.int32), np.array([len(f) for f in found], np.int64))
            # Each word of a text once, then each of its n-grams with the number of words that hold it.
            pair = np.unique(owner[word] * self.table.size + slots)
            held, sizes = self.grams.take(pair % max(1, self.table.size))
            hit = np.repeat(pair // max(1, self.table.size), sizes) * n + held
            for k in np.flatnonzero(flags).tolist():
                hit = np.append(hit, [k * n + g for w in words_of(texts[k]) for g in self.known(w)]).astype(np.int64)
            hit, times = np.unique(hit, return_counts=True)
            total = total + np.bincount(hit // n, self.weight[hit % n] * np.log2(1 + times), len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


_SCORERS: dict[str, Scorer] = kept("toxicity")


def scorer(model: Model) -> Scorer:
    """The scorer of a model, made once by each worker process."""
    if model.token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.token] = Scorer(model)
    return _SCORERS[model.token]


def score(model: Model, text: str) -> float:
    """The probability that a text is toxic."""
    return float(scorer(model).scores([text])[0])


def sample(texts: DataFrame, labels: DataFrame, learn: Column, column: str, max_rows: int) -> DataFrame:
    """(y, text) of the labelled texts to learn from, at most 2 * max_rows: one row for each id, of repeated ids the text with the smallest hash."""
    known = agreed_labels(labels, column).filter(learn).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [smallest_hashes(known.filter(F.col("y") == y), max_rows) for y in (0, 1)]
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "y", "text")).alias("r")).select("r.y", "r.text")
    return materialise(one.repartition(SAMPLE_TASKS), "learn")


def fit(texts: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    rows = sample(texts, labels, learn, column, max_rows)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    neg, pos = sizes.get(0, 0), sizes.get(1, 0)
    if not neg + pos:
        return Model()
    share = (pos + 1) / (neg + pos + 2)
    if not neg or not pos:
        return Model(float(np.log(share / (1 - share))))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        number: dict[str, int] = {}
        of = np.array(batch.column("y").to_pylist(), int)
        found = [ids for ids, _ in held(texts_of(batch), number, True)]
        sums = [np.bincount(np.concatenate([np.empty(0, np.int64), *(f for f, y in zip(found, of) if y == k)]), minlength=len(number)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *(pa.array(x, pa.int64()) for x in sums)], ["gram", "neg", "pos"])

    both = (F.col("neg") + F.col("pos")) / (neg + pos)
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(both * (1 - both) * (1 / neg + 1 / pos))
    table = map_texts(rows, "text", count, "gram string, neg long, pos long").groupBy("gram").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    table = table.filter((F.col("neg") + F.col("pos") >= MIN_TEXTS) & (both < 1)).withColumn("z", F.abs(z)).filter(F.col("z") >= MIN_Z)
    kept = table.orderBy(F.desc("z"), "gram").limit(MAX_GRAMS).collect()
    number = {r["gram"]: k for k, r in enumerate(kept)}
    ratio = np.array([np.log((r["pos"] + 1) / (pos + 2)) - np.log((r["neg"] + 1) / (neg + 2)) for r in kept])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(held(texts_of(batch), number, False))
        columns = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("y"), *columns], ["y", "found", "times"])

    sparse = map_texts(rows, "text", encode, "y int, found array<int>, times array<int>").toPandas()
    weight, bias = _logistic(sparse["y"].to_numpy(float), [np.asarray(f, int) for f in sparse["found"]], [np.asarray(t, float) for t in sparse["times"]], ratio)
    return Model(bias, dict(zip(number, (weight * ratio).tolist(), strict=True)))


def _logistic(y: np.ndarray, found: list[np.ndarray], times: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias, by steps of limited-memory BFGS that each lower the loss."""
    owner = np.repeat(np.arange(len(y)), [len(f) for f in found])
    column = np.concatenate(found) if found else np.empty(0, int)
    value = ratio[column] * np.log2(1 + np.concatenate(times)) if times else np.empty(0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(w[-1] + np.bincount(owner, value * w[column], len(y)), -30, 30)
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.append(np.bincount(column, value * error[owner], len(ratio)), error.sum())
        slope[:-1] += PENALTY * w[:-1]
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + PENALTY / 2 * np.sum(w[:-1] ** 2)), slope

    w = np.zeros(len(ratio) + 1)
    now, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        # The direction: the slope, bent by what the last steps told about the curvature.
        way, shares = slope.copy(), []
        for step, turn in reversed(past):
            shares.append(step @ way / (step @ turn))
            way -= shares[-1] * turn
        way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(slope), 1e-12)
        for (step, turn), share in zip(past, reversed(shares), strict=True):
            way += step * (share - turn @ way / (step @ turn))
        length, fall = 1.0, slope @ way
        while True:
            then, there = loss(w - length * way)
            if then <= now - 1e-4 * length * fall or length < 1e-9:
                break
            length /= 2
        if then >= now:
            break
        step, turn = -length * way, there - slope
        if step @ turn > 1e-12:
            past = [*past, (step, turn)][-MEMORY:]
        w, gained, now, slope = w + step, now - then, then, there
        if gained <= CONVERGED * now:
            break
    return w[:-1], float(w[-1])


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, column: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. Rows with crc32(doc_id) mod `modulus` = `held` are never learnt from."""
    texts = id_and_text(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, labels, remainder("doc_id", modulus) != held, column, max_rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = scorer(model.value).scores(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    scored = map_texts(texts, "text", run, "doc_id long, score double, predicted int", "toxicity")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", "predicted")
