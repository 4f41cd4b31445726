"""Masked pseudo-likelihood of documents under a window network that looks at both sides of each token.

Tokens are words. The network predicts every token from the two before and the two after it: embeddings, one hidden
layer of rectified units, and a softmax in two levels (class, then token in class) over the most frequent words by name
and slots for all others, by the hash of their last characters. A word of a slot is told from the others there by its
share of the slot's count, so every word of the corpus has a probability of its own; all unseen ones of a slot together
count as one word seen once. A document's score is the sum of the log probabilities of all its tokens, each given its
neighbours; the mean per token compares texts of any length.

The vocabulary follows the corpus: as a neighbour, a word of a slot adds a vector of its own to the slot's when it was
seen ``MIN_COUNT`` times or more, else the vector of a bucket by its whole hash; there is a bucket for every
``PER_BUCKET`` of the rarer distinct words. Counts and vectors are tables keyed by word. Rows are dealt into blocks of
bounded size, and a block is sent only the vectors of words that it holds.

Words are counted over all documents. Training goes over every document once, in ``ROUNDS`` rounds that take turns
row by row: in each, every task starts from the same weights and fits them to its rows by Adam in numpy, and the
weights are averaged by the number of tokens, summed up in ``GROUPS`` groups before they reach the driver; vectors are
averaged word by word, by how often a block trained them. What the driver holds has a fixed size, the tables grow with
the distinct words. Scores depend a little on how rows are dealt to tasks, as any averaged training does.

Null and empty texts have no tokens, the sum 0 and no mean. Rows with a null id, rows that share one and repeated rows
count and are scored each for itself; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import tables
from heliograph.sources import storage

CLASSES, MEMBERS = 32, 32
TOKENS = CLASSES * MEMBERS
NAMED = 768
SIDE, DIM, HIDDEN = 2, 24, 32
ROUNDS, BATCH, RATE = 2, 4096, 0.01
GROUPS = 64
MIN_COUNT = 5  # words outside the named ones that are seen this often have a vector of their own
PER_BUCKET = 8  # distinct rarer words for each bucket that they share
OWN_DIM = 8  # of a word's own vector, which is added to the first parts of its slot's
BLOCK = 1 << 23  # characters of a block's texts, but for its last text
OWN_RATE = 0.02
_MEMO = 500_000
_EDGE = TOKENS  # stands for what lies beyond a text's ends
_SCORE = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"
_OWN = [f"v{i}" for i in range(OWN_DIM)]
_SHAPES = {
    "embed": (TOKENS + 1, DIM),
    "mix": (2 * SIDE * DIM, HIDDEN),
    "mix_bias": (HIDDEN,),
    "class": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "member": (CLASSES, HIDDEN, MEMBERS),
    "member_bias": (CLASSES, MEMBERS),
}


def start(seed: int = 3) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    return {
        name: (random.normal(0, 0.1, shape) if not name.endswith("bias") else np.zeros(shape)).astype(np.float32)
        for name, shape in _SHAPES.items()
    }


def _flat(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[name].astype("<f4").tobytes() for name in _SHAPES)


def _model(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


class Model(dict):
    """Weights by name, and what the corpus holds outside the named words.

    ``words`` has a row (word, key, n) per word; ``vectors`` one (key, n, ``_OWN``) per trained key;
    ``slots`` the count of each slot.
    """

    words: DataFrame
    vectors: DataFrame | None = None
    slots: np.ndarray


class Words:
    """Token numbers of words; frequent ones are spread over the classes."""

    def __init__(self, named: list[str]):
        self._named = {w.encode(): r for r, w in enumerate(named)}
        self._memo: dict[bytes, bytes] = {}

    def number(self, word: bytes) -> bytes:
        rank = self._named.get(word)
        if rank is None:
            rank = NAMED + zlib.crc32(word[-3:]) % (TOKENS - NAMED)
        number = (rank % CLASSES * MEMBERS + rank // CLASSES).to_bytes(2, "little")
        if len(self._memo) < _MEMO:
            self._memo[word] = number
        return number

    def tokens(self, text: str | None) -> np.ndarray:
        """As numbers of two bytes, so that a text is one join and one view."""
        words = (text or "").lower().encode("utf-8", "replace").split()
        found = list(map(self._memo.get, words))
        if None in found:
            found = [self.number(w) if n is None else n for w, n in zip(words, found)]
        return np.frombuffer(b"".join(found), "<u2")


def _of_block(uri: str, block: int, columns: list[str]) -> pa.Table:
    """The rows of one block in a folder that is written by block."""
    system, path = tables.shared_files(f"{uri}/block={block}")
    if system.get_file_info(path).type == pa.fs.FileType.NotFound:
        kinds = {"word": pa.string(), "key": pa.string(), "n": pa.int64()}
        return pa.schema([(c, kinds.get(c, pa.float32())) for c in columns]).empty_table()
    return pa.dataset.dataset(path, filesystem=system, format="parquet").to_table(columns)


class Block:
    """Words outside the named ones in one block: their place in ``vectors``, and their counts."""

    def __init__(self, named: Words, words_uri: str, vectors_uri: str | None, block: int):
        rows = _of_block(words_uri, block, ["word", "key", "n"])
        words, keys = rows["word"].to_pylist(), rows["key"].combine_chunks().dictionary_encode()
        self.keys = keys.dictionary.to_pylist()
        # Place 0 stands for what has no vector.
        self.vectors = np.zeros((len(self.keys) + 1, OWN_DIM), np.float32)
        self.places, self.counts = np.zeros(len(words) + 1, np.int32), np.ones(len(words) + 1)
        self.places[1:] = keys.indices.to_numpy(zero_copy_only=False) + 1
        self.counts[1:] = rows["n"].to_numpy()
        if vectors_uri is not None:
            known = _of_block(vectors_uri, block, ["key", *_OWN])
            at = pa.compute.index_in(known["key"], value_set=keys.dictionary).to_numpy() + 1
            self.vectors[at] = np.stack([known[c].to_numpy() for c in _OWN], axis=1)
        self._named = named
        self._rows = {w.encode(): i for i, w in enumerate(words, 1)}
        self._memo: dict[bytes, bytes] = {}

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers as of ``Words``, and the row of each word here."""
        words = (text or "").lower().encode("utf-8", "replace").split()
        found = list(map(self._memo.get, words))
        if None in found:
            found = [self._pair(w) if n is None else n for w, n in zip(words, found)]
        pairs = np.frombuffer(b"".join(found), [("token", "<u2"), ("row", "<u4")])
        return np.ascontiguousarray(pairs["token"]), np.ascontiguousarray(pairs["row"])

    def _pair(self, word: bytes) -> bytes:
        pair = self._named.number(word) + self._rows.get(word, 0).to_bytes(4, "little")
        if len(self._memo) < _MEMO:
            self._memo[word] = pair
        return pair


@lru_cache(maxsize=2)
def _words(named: tuple[str, ...]) -> Words:
    return Words(list(named))


def windows(tokens: np.ndarray, edge: int = _EDGE, kind: type = np.uint16) -> np.ndarray:
    """For every token the ``SIDE`` tokens before and after it."""
    padded = np.full(len(tokens) + 2 * SIDE, edge, kind)
    padded[SIDE : len(tokens) + SIDE] = tokens
    out = np.empty((len(tokens), 2 * SIDE), kind)
    for i in range(SIDE):
        out[:, i] = padded[i : i + len(tokens)]
        out[:, SIDE + i] = padded[SIDE + 1 + i : SIDE + 1 + i + len(tokens)]
    return out


def _bounded(scores: np.ndarray) -> np.ndarray:
    """Far beyond any trained score, where the exponential of single precision still holds."""
    return np.clip(scores, -80, 80, out=scores)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(_bounded(scores))
    e /= (e @ np.ones(e.shape[1], e.dtype))[:, None]
    return e


def _picked(scores: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one column."""
    e = np.exp(_bounded(scores))
    return scores[np.arange(len(scores)), columns] - np.log(e @ np.ones(e.shape[1], e.dtype))


def _hidden(model: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    out = inputs @ model["mix"]
    out += model["mix_bias"]
    return np.maximum(out, 0, out=out)


def _by_class(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts tokens of a class together, and where each class begins and ends in it."""
    classes = (tokens // MEMBERS).astype(np.uint8)  # sorted by radix
    order = np.argsort(classes, kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


def _member_scores(model: dict[str, np.ndarray], hidden: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Scores of the members of each row's class; rows lie together by class."""
    out = model["member_bias"][classes]
    for c in range(CLASSES):
        rows = slice(bounds[c], bounds[c + 1])
        out[rows] += hidden[rows] @ model["member"][c]
    return out


def _slots(tokens: np.ndarray) -> np.ndarray:
    """The slot of each token, negative for named words."""
    return tokens % MEMBERS * CLASSES + tokens // MEMBERS - np.int32(NAMED)


def _shares(slots: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log share of each word in its slot by its count; a named word is alone."""
    held = _slots(tokens)
    return np.where(held < 0, 0.0, np.log(counts) - np.log1p(slots[np.maximum(held, 0)]))


def _inputs(model: dict[str, np.ndarray], context: np.ndarray, own: np.ndarray | None, vectors: np.ndarray | None) -> np.ndarray:
    """Embeddings of the context, with the words' own vectors where given."""
    out = model["embed"][context]
    if own is not None:
        out[:, :, :OWN_DIM] += vectors[own]
    return out.reshape(len(context), -1)


def log_probs(
    model: dict[str, np.ndarray], context: np.ndarray, tokens: np.ndarray, own: np.ndarray | None = None, vectors: np.ndarray | None = None
) -> np.ndarray:
    """Log probability of each token given its context."""
    hidden = _hidden(model, _inputs(model, context, own, vectors))
    out = _picked(hidden @ model["class"] + model["class_bias"], tokens // MEMBERS)
    order, bounds = _by_class(tokens)
    placed = tokens[order]
    out[order] += _picked(_member_scores(model, hidden[order], placed // MEMBERS, bounds), placed % MEMBERS)
    return out


def _summed(places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and the sum of the rows of each."""
    order = np.argsort(places, kind="stable")
    ids = places[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[first], np.add.reduceat(rows[order], first, axis=0)


def gradient(
    model: dict[str, np.ndarray], context: np.ndarray, tokens: np.ndarray, own: np.ndarray | None = None, vectors: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """Of the mean negative log probability; for the words' own vectors, their places and rows."""
    n, out = len(tokens), {}
    # Rows by class from the start, so that each class is one slice.
    order, bounds = _by_class(tokens)
    context, tokens, rows = context[order], tokens[order], np.arange(n)
    classes = tokens // MEMBERS
    own = None if own is None else own[order]
    inputs = _inputs(model, context, own, vectors)
    hidden = _hidden(model, inputs)
    error = _softmax(hidden @ model["class"] + model["class_bias"])
    error[rows, classes] -= 1
    error /= n
    out["class"], out["class_bias"] = hidden.T @ error, error.sum(axis=0)
    back = error @ model["class"].T
    inner = _softmax(_member_scores(model, hidden, classes, bounds))
    inner[rows, tokens % MEMBERS] -= 1
    inner /= n
    out["member"], out["member_bias"] = np.zeros_like(model["member"]), np.zeros_like(model["member_bias"])
    for c in range(CLASSES):
        part = slice(bounds[c], bounds[c + 1])
        out["member"][c] = hidden[part].T @ inner[part]
        out["member_bias"][c] = inner[part].sum(axis=0)
        back[part] += inner[part] @ model["member"][c].T
    back *= hidden > 0
    out["mix"], out["mix_bias"] = inputs.T @ back, back.sum(axis=0)
    spread = (back @ model["mix"].T).reshape(-1, DIM)
    places, sums = _summed(context.ravel(), spread)
    out["embed"] = np.zeros_like(model["embed"])
    out["embed"][places] = sums
    if own is not None and own.any():
        held = np.flatnonzero(own.ravel())
        out["own"] = _summed(own.ravel()[held], spread[held, :OWN_DIM])
    return out


class Trainer:
    """Adam over batches of windows; texts are queued until a batch is full."""

    def __init__(self, model: dict[str, np.ndarray], batch: int = BATCH):
        self.model = {name: w.copy() for name, w in model.items()}
        self.seen = 0
        self._batch, self._steps = batch, 0
        self._first = {name: np.zeros_like(w) for name, w in model.items()}
        self._second = {name: np.zeros_like(w) for name, w in model.items()}
        self._held: list[tuple[np.ndarray, ...]] = []
        self._size = 0
        self.block: Block | None = None

    def begin(self, block: Block) -> None:
        """The texts that follow are of this block."""
        self.flush()
        self.block = block
        self._squares = np.zeros_like(block.vectors)
        self.times = np.zeros(len(block.vectors), np.int64)  # that a word was a neighbour

    def add(self, tokens: np.ndarray, own: np.ndarray | None = None) -> None:
        if not len(tokens):
            return
        self._held.append((windows(tokens), tokens) if own is None else (windows(tokens), tokens, windows(own, 0, np.int32)))
        self._size += len(tokens)
        if self._size >= self._batch:
            self.flush()

    def flush(self) -> None:
        if not self._size:
            return
        columns = [np.concatenate(x) for x in zip(*self._held)]
        self._held, self._size, self.seen = [], 0, self.seen + len(columns[1])
        for at in range(0, len(columns[1]), self._batch):
            self._step(*(x[at : at + self._batch] for x in columns))

    def _step(self, context: np.ndarray, tokens: np.ndarray, own: np.ndarray | None = None) -> None:
        self._steps += 1
        rate = np.float32(RATE * (1 - 0.999**self._steps) ** 0.5 / (1 - 0.9**self._steps) / (1 + self._steps / 500))
        found = gradient(self.model, context, tokens, own, None if own is None else self.block.vectors)
        if "own" in found:
            # Adagrad, as a step meets few of the words.
            places, g = found.pop("own")
            self._squares[places] += g * g
            self.block.vectors[places] -= np.float32(OWN_RATE) * g / (np.sqrt(self._squares[places]) + np.float32(1e-12))
            self.times += np.bincount(own.ravel(), minlength=len(self.times))
        for name, g in found.items():
            first, second = self._first[name], self._second[name]
            first += np.float32(0.1) * (g - first)
            second += np.float32(0.001) * (g * g - second)
            self.model[name] -= rate * first / (np.sqrt(second) + np.float32(1e-8))


def _counted(words: DataFrame) -> list[str]:
    return [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(NAMED).collect()]


def frequent_words(docs: DataFrame, text_column: str = "text") -> list[str]:
    """The ``NAMED`` most frequent words, counted over all documents."""
    words = docs.select(F.explode(F.split(F.lower(tables.whole_text(text_column)), tables.SPACES)).alias("word"))
    return _counted(words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows``, whose last column is a text, written with the block of each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            blocks = []
            for size in pa.compute.utf8_length(batch.column(batch.num_columns - 1)).to_pylist():
                if held >= BLOCK:
                    block, held = block + 1, 0
                blocks.append(block)
                held += size or 0
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return storage.checkpoint(rows.mapInArrow(deal, f"block long, {schema}"))


def _pairs(dealt: DataFrame) -> DataFrame:
    """Every word of every block with its count there."""
    words = dealt.select("block", F.explode(F.split(F.lower(tables.whole_text("text")), tables.SPACES)).alias("word"))
    return storage.checkpoint(words.filter("word <> ''").groupBy("block", "word").agg(F.count("*").alias("n")))


def vocabulary(counts: DataFrame, named: tuple[str, ...]) -> tuple[DataFrame, np.ndarray]:
    """(word, key, n) of every word outside the named ones, and the count of each slot.

    The key is the word itself or, of a rarer one, its bucket; no word holds a space, so they differ.
    """
    others = counts.filter(~F.col("word").isin(*named)) if named else counts
    ends = F.crc32(F.substring(F.encode("word", "utf-8"), -3, 3))
    slots = np.zeros(TOKENS - NAMED)
    for r in others.groupBy(F.pmod(ends, F.lit(TOKENS - NAMED)).alias("slot")).agg(F.sum("n").alias("n")).collect():
        slots[r["slot"]] = r["n"]
    rare = F.col("n") < MIN_COUNT
    buckets = max(1, -(-others.filter(rare).count() // PER_BUCKET))
    bucket = F.concat(F.lit(" "), F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("string"))
    return storage.checkpoint(others.select("word", F.when(rare, bucket).otherwise(F.col("word")).alias("key"), "n")), slots


def _by_block(rows: DataFrame) -> str:
    path = tables.scratch_dir(rows.sparkSession, "pseudo-lm")
    with storage.without_shuffles(rows.sparkSession):
        rows.repartition("block").write.options(**storage.WRITTEN).partitionBy("block").parquet(path)
    return path


def _words_by_block(pairs: DataFrame, named: tuple[str, ...], model: Model) -> str:
    """A folder for each block, with the words in it; unseen ones count as one word seen once."""
    words = pairs.select("block", "word").filter(~F.col("word").isin(*named)) if named else pairs.select("block", "word")
    rows = words.join(model.words, "word", "left")
    # A word that only these rows hold has no vector.
    return _by_block(rows.select("block", "word", F.coalesce("key", F.lit(" ")).alias("key"), F.coalesce("n", F.lit(1)).cast("long").alias("n")))


def _vectors_by_block(spark: SparkSession, words: str, model: Model) -> str | None:
    """A folder for each block, with the vectors of its words."""
    if model.vectors is None:
        return None
    held = spark.read.schema("key string, block long").parquet(words).distinct()
    return _by_block(held.join(model.vectors.select("key", *_OWN), "key"))


def fit(docs: DataFrame, text_column: str = "text", rounds: int = ROUNDS) -> tuple[tuple[str, ...], Model]:
    """Words and weights, learned from every document."""
    tables.ship(docs.sparkSession)
    dealt = _dealt(docs.select(tables.whole_text(text_column).alias("text")))
    return _fit(dealt, _pairs(dealt), rounds)[:2]


def _fit(dealt: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> tuple[tuple[str, ...], Model, str]:
    """Words and weights, and the folder of the blocks' words."""
    counts = storage.checkpoint(pairs.groupBy("word").agg(F.sum("n").alias("n")))
    named, model = tuple(_counted(counts)), Model(start())
    model.words, model.slots = vocabulary(counts, named)
    held = _words_by_block(pairs, named, model)
    texts = dealt.select("block", "text")
    for turn in range(rounds):
        path = _vectors_by_block(dealt.sparkSession, held, model)

        def learn(batches: Iterator[pa.RecordBatch], flat=_flat(model), turn=turn, path=path) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer, words = Trainer(_model(np.frombuffer(flat, "<f4"))), _words(named)
            rows = ((block, text) for batch in batches for block, text in zip(batch.column(0).to_pylist(), batch.column(1)))
            for block, own_texts in itertools.groupby(rows, lambda r: r[0]):
                trainer.begin(Block(words, held, path, block))
                for _, text in itertools.islice(own_texts, turn, None, rounds):
                    tokens, own = trainer.block.tokens(text.as_py())
                    trainer.add(tokens, trainer.block.places[own])
                trainer.flush()
                met = np.flatnonzero(trainer.times[1:]) + 1
                if len(met):
                    yield _learned(
                        seen=trainer.times[met], key=[trainer.block.keys[i - 1] for i in met.tolist()], vectors=trainer.block.vectors[met]
                    )
            if trainer.seen:
                yield _learned([trainer.seen], part=TaskContext.get().partitionId() % GROUPS, weights=_flat(trainer.model))

        def summed(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(w, "<f4").astype(np.float64) * n for w, n in zip(rows["weights"], rows["seen"]))
            return pd.DataFrame({"seen": [int(rows["seen"].sum())], "weights": [total.astype("<f8").tobytes()]})

        # What the tasks learned and the vectors they were sent go with the round.
        with storage.kept(texts.mapInArrow(learn, _LEARNED)) as learned:
            _take(model, learned, summed)
        if path is not None:
            storage.remove(dealt.sparkSession, path)
    return named, model, held


def _take(model: Model, learned: DataFrame, summed) -> None:
    """Average what the tasks of a round learned into the model."""
    dense = learned.filter("weights IS NOT NULL").select("part", "seen", "weights")
    sums = dense.groupBy("part").applyInPandas(summed, "seen long, weights binary").collect()  # at most GROUPS rows
    seen = sum(r["seen"] for r in sums)
    if not seen:
        return
    model.update(_model(sum(np.frombuffer(bytes(r["weights"]), "<f8") for r in sums) / seen))
    trained = learned.filter("key IS NOT NULL").select("key", "seen", *_OWN)
    if model.vectors is not None:  # words that this round did not meet keep what they have
        met = trained.select("key").distinct()
        trained = trained.unionByName(model.vectors.withColumnRenamed("n", "seen").join(met, "key", "left_anti"))
    mean = [(F.sum(F.col(c) * F.col("seen")) / F.sum("seen")).cast("float").alias(c) for c in _OWN]
    model.vectors = storage.checkpoint(trained.groupBy("key").agg(F.sum("seen").alias("n"), *mean))


_LEARNED = "part int, seen long, weights binary, key string, " + ", ".join(f"{c} float" for c in _OWN)


def _learned(seen, part: int | None = None, weights: bytes | None = None, key: list[str] | None = None, vectors: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``_LEARNED``: the weights of a task, or the vectors of a block's words."""
    n = len(seen)
    columns = [pa.array([part] * n, pa.int32()), pa.array(seen, pa.int64()), pa.array([weights] * n, pa.binary())]
    columns.append(pa.array(key or [None] * n, pa.string()))
    columns += [pa.nulls(n, pa.float32()) if vectors is None else pa.array(np.ascontiguousarray(vectors[:, i])) for i in range(OWN_DIM)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "seen", "weights", "key", *_OWN])


def _sums(model: dict[str, np.ndarray], slots: np.ndarray, block: Block, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Summed log probabilities of each text, over all texts in even chunks."""
    if not texts:
        return []
    context, tokens = np.concatenate([windows(t) for t, _ in texts]), np.concatenate([t for t, _ in texts])
    own = np.concatenate([windows(block.places[r], 0, np.int32) for _, r in texts])
    shares = _shares(slots, tokens, block.counts[np.concatenate([r for _, r in texts])])
    parts = [slice(at, at + BATCH) for at in range(0, len(tokens), BATCH)]
    logs = [log_probs(model, context[p], tokens[p], own[p], block.vectors) + shares[p] for p in parts]
    ends = np.concatenate([[0.0], np.cumsum(np.concatenate([np.empty(0), *logs]), dtype=np.float64)])
    stops = np.cumsum([len(t) for t, _ in texts])
    return [float(ends[b] - ends[b - len(t)]) for (t, _), b in zip(texts, stops.tolist())]


def score(docs: DataFrame, named: tuple[str, ...], model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all tokens) and mean_log_prob for every row."""
    tables.ship(docs.sparkSession)
    dealt = _dealt(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    return _score(dealt, named, model, _words_by_block(_pairs(dealt), named, model))


def fit_and_score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What ``score`` gives for the rows that the model is learned from; their words are counted once."""
    tables.ship(docs.sparkSession)
    dealt = _dealt(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    named, model, held = _fit(dealt, _pairs(dealt))
    return _score(dealt, named, model, held)


def _score(dealt: DataFrame, named: tuple[str, ...], model: Model, held: str) -> DataFrame:
    path, weights, slots = _vectors_by_block(dealt.sparkSession, held, model), dict(model), model.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, at = _words(named), None, None
        for batch in batches:
            counts, sums, texts, size = [], [], [], 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if size >= 4 * BATCH or number != at:
                    sums += _sums(weights, slots, block, texts)
                    texts, size = [], 0
                if number != at:
                    block, at = Block(words, held, path, number), number
                texts.append(block.tokens(text.as_py()))
                counts.append(len(texts[-1][0]))
                size += counts[-1]
            sums += _sums(weights, slots, block, texts)
            means = [s / n if n else None for s, n in zip(sums, counts)]
            columns = [pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return dealt.mapInArrow(run, _SCORE)
