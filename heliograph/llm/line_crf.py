"""Document quality by a linear-chain conditional random field over lines.

Each line with a word is good or bad. What speaks for either are binned measures of the line (length, letters,
digits, symbols, repeated words, ...) and of the lines before and after it; neighbouring labels are tied by
transition weights. Labels are known per document, so in training all lines of a document carry its label. The
field is fitted in numpy on a bounded sample (``SAMPLE`` documents, ``WINDOW`` lines of each); the measures are taken on the
executors, so what comes to the driver has a fixed size.

A document's score is the mean probability of "good" of its lines by forward-backward, weighted by their length.
Every line of every text counts. Null and empty texts, and texts without a word, get the share of good documents in
the sample. Without labels to learn from every score is 0.5. Labels, language, source and id are never inputs.
Rows with a null id, rows that share one and repeated rows are scored each for itself; learning takes one text of each
labelled id. Other columns are carried along by ``keep_good`` and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm import folds, tables

SAMPLE, WINDOW = 4000, 32
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.05, 1e-3
THRESHOLD = 0.3
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOLS, _STOPS = b"#*$%&|<>!@^~=+_{}[]\\/", b".,;:?'\"()-"
_HIGH = bytes(range(128, 256))
_EDGES = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.22, 0.3, 0.45, 0.6, 0.8])
_BINS = len(_EDGES) + 2  # the last one stands for a line that is not there
MEASURES = 13


def _measures(line: bytes, words: list[bytes], before: bytes) -> tuple[float, ...]:
    size, n = len(line), len(words)
    share = [(size - len(line.translate(None, kind))) / size for kind in (_UPPER, _DIGITS, _SYMBOLS, _STOPS, _HIGH)]
    same = sum(a == b for a, b in zip(words, words[1:]))
    longest = max(map(len, words))
    return (
        *share,
        line.count(b" ") / size,
        1 - len(set(words)) / n,
        same / n,
        math.log1p(n) / 10,
        math.log1p(size) / 12,
        min(1.0, size / n / 30),
        min(1.0, longest / 100),
        float(line == before),
    )


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Per line with a word: bins of its measures, and its length in bytes."""
    rows, sizes, before = [], [], b""
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        if words:
            rows.append(_measures(line, words, before))
            sizes.append(len(line))
            before = line
    if not rows:
        return np.empty((0, MEASURES), np.int16), np.empty(0)
    return np.digitize(np.array(rows), _EDGES).astype(np.int16), np.array(sizes, float)


def _with_neighbours(bins: np.ndarray) -> np.ndarray:
    """Weight numbers of each line's own, previous and next measures."""
    missing = np.full((1, MEASURES), _BINS - 1, bins.dtype)
    stacked = np.concatenate([bins, np.concatenate([missing, bins[:-1]]), np.concatenate([bins[1:], missing])], axis=1)
    return stacked.astype(np.int64) + np.arange(3 * MEASURES) * _BINS


@dataclass(frozen=True)
class Model:
    """Weights speak for "good" against "bad": per measure, for staying good, staying bad, and overall."""

    weights: np.ndarray
    stay_good: float
    stay_bad: float
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        bins, sizes = lines_of(text)
        if not len(bins):
            return self.prior
        lean = (self.weights[_with_neighbours(bins)].sum(axis=1) + self.bias).tolist()
        good = _marginals(lean, self.stay_good, self.stay_bad)
        return float(np.dot(good, sizes) / sizes.sum())


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _marginals(lean: list[float], stay_good: float, stay_bad: float) -> np.ndarray:
    """Probability of good per line by forward-backward, on log odds."""

    def passed(odds: float) -> float:
        return _softplus(odds + stay_good) - (odds + _softplus(stay_bad - odds))

    forward, backward = [0.0] * len(lean), [0.0] * len(lean)
    for t in range(1, len(lean)):
        forward[t] = passed(forward[t - 1] + lean[t - 1])
    for t in range(len(lean) - 2, -1, -1):
        backward[t] = passed(backward[t + 1] + lean[t + 1])
    odds = np.clip(np.array(forward) + lean + backward, -500, 500)
    return 1 / (1 + np.exp(-odds))


def train(windows: list[np.ndarray], labels: list[int], seed: int = 11) -> Model:
    """Adam on the likelihood of all lines carrying their document's label; ``windows`` hold bins of lines."""
    if not labels:
        return Model(np.zeros(3 * MEASURES * _BINS), 0.0, 0.0, 0.0, 0.5)
    prior = float(np.mean(labels))
    kept = [(_with_neighbours(w), y) for w, y in zip(windows, labels) if len(w)]
    random = np.random.default_rng(seed)
    size = 3 * MEASURES * _BINS
    weights = np.zeros(size + 3)  # measures, stay_good, stay_bad, bias
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for epoch in range(EPOCHS if kept else 0):
        order = random.permutation(len(kept))
        for at in range(0, len(order), BATCH):
            chosen = [kept[i] for i in order[at : at + BATCH]]
            gradient = _gradient(chosen, weights, size) + DECAY * weights
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            rate = RATE * (1 - epoch / EPOCHS)
            weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(weights[:size], float(weights[size]), float(weights[size + 1]), float(weights[size + 2]), prior)


def _gradient(chosen: list[tuple[np.ndarray, int]], weights: np.ndarray, size: int) -> np.ndarray:
    """Expected minus observed counts, by forward-backward over all windows at once."""
    longest = max(len(w) for w, _ in chosen)
    there = np.zeros((len(chosen), longest), bool)
    lean = np.zeros((len(chosen), longest))
    for i, (numbers, _) in enumerate(chosen):
        there[i, : len(numbers)] = True
        lean[i, : len(numbers)] = weights[numbers].sum(axis=1) + weights[size + 2]
    labels = np.array([y for _, y in chosen], float)
    good, bad = weights[size], weights[size + 1]

    def passed(odds):
        return np.logaddexp(0, odds + good) - np.logaddexp(odds, bad)

    forward, backward = np.zeros_like(lean), np.zeros_like(lean)
    for t in range(1, longest):
        forward[:, t] = passed(forward[:, t - 1] + lean[:, t - 1])
    for t in range(longest - 2, -1, -1):
        backward[:, t] = np.where(there[:, t + 1], passed(backward[:, t + 1] + lean[:, t + 1]), 0)
    chance = 1 / (1 + np.exp(-np.clip(forward + lean + backward, -500, 500)))
    error = np.where(there, chance - labels[:, None], 0)
    out = np.zeros(size + 3)
    for i, (numbers, _) in enumerate(chosen):
        np.add.at(out, numbers, error[i, : len(numbers), None])
    out[size + 2] = error.sum()
    if longest > 1:
        pair = there[:, 1:]
        a = forward[:, :-1] + lean[:, :-1]
        b = lean[:, 1:] + backward[:, 1:]
        logs = np.stack([a + b + good, a, b, np.zeros_like(a) + bad])  # good-good, good-bad, bad-good, bad-bad
        chances = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
        out[size] = np.where(pair, chances[0] - labels[:, None], 0).sum()
        out[size + 1] = np.where(pair, chances[3] - (1 - labels[:, None]), 0).sum()
    return out / len(chosen)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows = []
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            bins, _ = lines_of(text.as_py())
            start = abs(doc_id.as_py() or 0) % max(1, len(bins) - WINDOW + 1)
            windows.append(bins[start : start + WINDOW].astype(np.int16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), batch.column(2)], names=["bins", "label"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Learn from labelled documents (``labels``: id and 0 or 1) where ``usable`` holds for the label's row."""
    tables.ship(docs.sparkSession)
    marked = labels.filter(usable & F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    present = marked.join(docs.select(F.col(id_column).alias("id")), "id", "left_semi")
    chosen = F.broadcast(folds.sample(present, "id", SAMPLE))  # at most SAMPLE rows
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # One text for each chosen label, however often its id is in the table.
    sampled = texts.join(chosen, "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sampled.select(F.col("id").cast("long").alias("id"), "text", "label")
    found = rows.mapInArrow(_windows, "bins binary, label int").toArrow().to_pydict()
    pairs = sorted(zip(found["label"], found["bins"]))
    return train([np.frombuffer(b, np.int16).reshape(-1, MEASURES) for _, b in pairs], [y for y, _ in pairs])


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(text.as_py()) for text in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from ``THRESHOLD`` on) for every row."""
    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents that are predicted good, with all their columns; scored in place, nothing is shuffled."""
    tables.ship(docs.sparkSession)
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) >= THRESHOLD for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
