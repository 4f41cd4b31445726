"""Language of a text by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; its subwords are the runs of two to four characters inside words, with the word's ends
marked, hashed into buckets. The mean of their embeddings goes through a linear layer and a softmax. Embeddings
and layer are trained by stochastic gradient descent in numpy on crops of a bounded sample (``PER_LANGUAGE``
documents a language, ``SAMPLE`` in all, ``CROPS`` crops of at most ``CROP`` subwords each): what comes to the driver
has a fixed size. A tenth of the sample is held back to fit the temperature of the scores and the score below which
a prediction is marked as rejected.

Every text is scored whole. Since the model is linear in the mean, embeddings and layer are multiplied out into one
score per bucket and language, and a text's scores are a mean of table rows. Null texts and texts without a letter
get ``und`` and score 0. An exit, where there was nothing to learn from (no usable row, an empty table): every text
gets ``und``. Rows with a null id, rows that share one and repeated rows are scored each for itself; learning takes one
text of each id and none without an id. Other columns are never read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm import tables
from heliograph.operators.sides import broadcast_if_small
from heliograph.sources import storage

BUCKETS, DIM = 1 << 16, 16
PER_LANGUAGE, SAMPLE, CROPS, CROP = 1000, 8000, 3, 256
EPOCHS, RATE = 8, 0.5
ACCEPTED = 0.98  # share of right predictions among those that are not rejected, on the part held back
UNKNOWN = "und"
_SPAN = 1 << 16  # characters that are hashed at a time
_PREDICTION = "doc_id long, lang_pred string, score double, rejected boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _span_buckets(points: np.ndarray) -> np.ndarray:
    """Buckets of the subwords of characters in which everything but letters is a space."""
    letter = points != 32
    out = []
    hashed = points.astype(np.uint32) * np.uint32(0x9E3779B1)
    inner = np.ones(len(points), bool)
    code = hashed.copy()
    for n in range(2, 5):
        size = len(points) - n + 1
        if size <= 0:
            break
        code = (code[:size] ^ (code[:size] >> np.uint32(15))) * np.uint32(0x85EBCA77) + hashed[n - 1 :]
        inner = inner[:size] & (letter[n - 2 : n - 2 + size] if n > 2 else True)
        keep = inner if n > 2 else letter[:size] | letter[1:]
        picked = code[keep] + np.uint32(n)
        out.append((picked ^ (picked >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's subwords, some characters at a time; nothing for a text without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), _SPAN):
        # Three characters of overlap; a subword that begins in them belongs to the next span.
        span = points[at : at + _SPAN]
        span = np.where(_letters()[span], span, 32)
        padded = np.concatenate(([32], span, [32])).astype(np.uint32)
        if (span != 32).any():
            yield _span_buckets(padded)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # score per bucket and language
    bias: np.ndarray
    temperature: float
    floor: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        total, count = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            if len(self.languages):
                total += self.table[buckets].sum(axis=0, dtype=np.float64)
            count += len(buckets)
        if not count or not self.languages:
            return UNKNOWN, 0.0, True
        chances = _softmax((total / count + self.bias) / self.temperature)
        best = int(chances.argmax())
        score = float(chances[best])
        return self.languages[best], score, score < self.floor


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(crops: list[np.ndarray], labels: list[str], seed: int = 7) -> Model:
    """Fit on crops of buckets, one label each."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    random = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    held = random.random(len(crops)) < 0.1
    fitted = np.flatnonzero(~held) if (~held).any() else np.arange(len(crops))
    embed = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = random.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fitted), 0
    for _ in range(EPOCHS):
        for i in random.permutation(fitted):
            buckets = crops[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = embed[buckets].mean(axis=0)
            error = _softmax(mean @ layer + bias)
            error[target[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            np.subtract.at(embed, buckets, (rate * 16 / len(buckets)) * back)
    table = embed @ layer
    check = np.flatnonzero(held) if held.any() else fitted
    scores = np.array([table[crops[i]].mean(axis=0) + bias for i in check])
    truth = target[check]
    rows = np.arange(len(check))
    temperatures = np.geomspace(0.25, 8, 41)
    loss = [-np.log(_softmax(scores / t)[rows, truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    chances = _softmax(scores / temperature)
    best, right = chances.max(axis=1), chances.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPTED)
    floor = float(best[order][precise[-1]]) if len(precise) else 1.0
    return Model(languages, table.astype(np.float32), bias.astype(float), temperature, floor)


def _cropper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, crops = [], []
        for doc_id, text, label in zip(*(c for c in batch.columns)):
            random = np.random.default_rng(abs(doc_id.as_py() or 0))
            spans = list(subwords(text.as_py()))
            buckets = np.concatenate(spans) if spans else np.empty(0, np.uint32)
            # Subwords of one length lie together; in text order a crop would hold one length only.
            for n in range(CROPS if len(buckets) else 0):
                size = min(len(buckets), CROP >> 2 * n)
                labels.append(label.as_py())
                crops.append(random.choice(buckets, size, replace=False).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(crops, pa.list_(pa.int32()))], names=["label", "crop"])


def fit(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Learn from the rows where ``usable`` holds and the label is not null."""
    tables.ship(docs.sparkSession)
    rows = docs.filter(usable & F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    narrow = rows.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    # Of a frequent label only ids with a small hash compete: about four times as many as are wanted, in one task.
    counts = storage.checkpoint(narrow.groupBy("label").agg(F.count("*").alias("n")).withColumnRenamed("label", "_label"))
    share = F.xxhash64("id") / F.lit(2.0**64) + F.lit(0.5)
    competing = narrow.join(broadcast_if_small(counts), F.col("label") == F.col("_label")).filter(share * F.col("n") < 4.0 * PER_LANGUAGE)
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ranked = competing.select("id", "label", F.row_number().over(by_hash).alias("rank")).filter(F.col("rank") <= PER_LANGUAGE)
    first = ranked.orderBy("rank", F.xxhash64("id")).limit(SAMPLE).select("id", "label").distinct()
    chosen = F.broadcast(first)  # at most SAMPLE rows
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # One text for each chosen id, however often it is in the table.
    sampled = texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    crops = sampled.select(F.col("id").cast("long").alias("id"), "text", "label").mapInArrow(_cropper, "label string, crop array<int>")
    found = crops.toArrow().to_pydict()
    pairs = sorted(zip(found["label"], found["crop"]))
    return train([np.array(c, np.int64) for _, c in pairs], [label for label, _ in pairs])


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [model.predict(text.as_py()) for text in batch.column(1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    return predict


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row; the model has BUCKETS rows, whatever the data."""
    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_predictor(model), _PREDICTION)
