"""Near duplicates by MinHash bands, odd sketches and confirmation on full shingle sets.

A document is the set of its distinct word shingles (A-Z lower-cased, words between white space); with fewer
words than a shingle has, the whole sequence is the one shingle; without words the set is empty and linked with
nothing. Two documents are linked when 100 * intersection >= percent * union. Shingles are held as 64-bit hashes.

1. Documents with equal sets form a class; only its smallest id goes on. A thousand copies cost one row.
2. Band keys over MinHash values make buckets. The number of bands follows from the similarity, so that a link
   is missed with a probability below ``MISS``.
3. One-permutation MinHash samples (the least hash in each of ``BINS`` bins) are folded into a parity bitmap of
   ``BITS`` bits, the odd sketch. The population count of two bitmaps' XOR tells how many samples differ, and
   with the set sizes the similarity: nearly exactly for sets smaller than the bins, else within a known error.
   Pairs that differ in more bits than one at the bar would, by ``SIGMAS`` such errors, are left out.
4. In each bucket everyone is paired with the smallest id; each document's best pair is confirmed on the sets,
   and what is linked becomes a component.
5. Buckets that still hold several components are searched in blocks, all against all by sketch, but only
   between components: each document of the smaller one names its best partners, which are confirmed; a pair
   is named in the first bucket it shares. This repeats, with more partners each time, until no unconfirmed pair is left between two components. So no pair
   inside a component is ever made, and no link between components is passed over.

Components are found by alternating large and small stars; nothing is collected. Rows that share an id are one
document to the links. A null id is never linked. Null texts are empty, and long ones are one row's set; ``link``
ignores other columns, ``keep_one`` carries them along. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import tables
from heliograph.sources import storage

WORDS, PERCENT = 5, 80
MISS = 1e-7
BINS, BITS = 4096, 2048
SIGMAS = 5.0
BLOCK = 1024  # members of a bucket that are compared with one another in one task
PARTNERS = 8  # best partners a document names in the first search; eight times as many in each next one
_MEMO = 500_000
_CHUNK = 8192
_PAIRS = 1 << 16
_SIGNATURE = "doc_id long, n_shingles long, class binary, bands array<long>, n_bins int, sketch binary"
_U64 = np.uint64


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows per band: fewer rows for a lower bar, as many bands as ``MISS`` asks for."""
    similarity = percent / 100
    rows = max(1, min(8, round(math.log(0.42) / math.log(similarity)))) if percent < 100 else 8
    hit = similarity**rows
    return (1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))), rows


@lru_cache(maxsize=1)
def _memo() -> dict[bytes, int]:
    return {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the six white-space bytes
    if not found:
        return np.empty(0, _U64)
    memo = _memo()
    hashes = list(map(memo.get, found))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = xxhash.xxh64_intdigest(found[i])
                if len(memo) < _MEMO:
                    memo[found[i]] = hashes[i]
    values = np.array(hashes, _U64)
    width = min(words, len(values))
    mixed = np.full(len(values) - width + 1, width, _U64)
    for i in range(width):
        mixed = _mix(mixed * _U64(0x9E3779B97F4A7C15) + values[i : len(values) - width + 1 + i])
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return (random.integers(0, 2**32, count, np.uint32) | np.uint32(1)), random.integers(0, 2**32, count, np.uint32)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    factors, offsets = _permutations(bands * rows)
    low = (hashes >> _U64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _CHUNK):
        least = np.minimum(least, (low[at : at + _CHUNK, None] * factors + offsets).min(axis=0))
    keys = np.arange(1, bands + 1, dtype=_U64)
    for column in least.reshape(bands, rows).T:
        keys = _mix(keys * _U64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """Number of bins with a sample, and the parity bitmap of the samples."""
    # Sorted by bin and then by value, the first of each bin is its sample.
    ordered = np.sort(_mix(hashes))
    bins = ordered >> _U64(64 - BINS.bit_length() + 1)
    samples = ordered[np.concatenate(([True], bins[1:] != bins[:-1]))] if len(ordered) else ordered
    places = (_mix(samples ^ _U64(0x5851F42D4C957F2D)) & _U64(BITS - 1)).astype(np.int64)
    return len(samples), np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def may_link(n_a, n_b, bins_a, bins_b, differing, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarity estimated from the XOR's population count, and whether it leaves a link possible.

    What is excluded is decided with the union that a pair at the bar would have; for the estimate itself
    the union follows from the similarity, which a few rounds settle.
    """
    bar = percent / 100
    n_a, n_b, bins_a, bins_b, differing = (np.asarray(x, float) for x in (n_a, n_b, bins_a, bins_b, differing))
    union = (n_a + n_b) / (1 + bar)
    filled = BINS * -np.expm1(-union / BINS)
    # Bins that the two sets fill beyond what is expected, their union fills as well: most shingles are common.
    beyond = (bins_a + BINS * np.expm1(-n_a / BINS) + bins_b + BINS * np.expm1(-n_b / BINS)) / 2
    filled = np.clip(filled + beyond, np.maximum(bins_a, bins_b), BINS)
    # Differing samples and differing bits of a pair at the bar, with their spread.
    samples = np.maximum(bins_a + bins_b - 2 * bar * filled, 0)
    slope, load = np.exp(-2 * samples / BITS), 4 * samples / BITS
    sampling = 4 * filled * bar * (1 - bar) * np.maximum(1 - filled / union, 0)
    folding = BITS / 4 * (1 - np.exp(-load) * (1 + load))
    limit = BITS / 2 * (1 - slope) + SIGMAS * np.sqrt(slope**2 * sampling + folding) + 3
    near = (differing <= limit) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    same = (bins_a + bins_b + BITS / 2 * np.log1p(-np.minimum(2 * differing / BITS, 0.98))) / 2
    estimate = same / filled
    for _ in range(8):
        estimate = np.clip(same / (BINS * -np.expm1(-(n_a + n_b) / (1 + estimate) / BINS)), 0, 1)
    return estimate, near


def _signer(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        names = ["doc_id", "n_shingles", "class", "bands", "n_bins", "sketch"]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingles(text.as_py(), words)
                if len(hashes):
                    keys = band_keys(hashes, bands, rows)
                    out.append((doc_id, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), keys, *odd_sketch(hashes)))
                else:
                    out.append((doc_id, 0, None, None, 0, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)

    return sign


def _set_maker(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return make


def _sketch_rater(percent: int):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in batch.schema.names}
            bits_a, bits_b = (np.frombuffer(b"".join(column[c].to_pylist()), _U64).reshape(-1, BITS // 64) for c in ("sketch_a", "sketch_b"))
            differing = np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)
            numbers = [column[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "bins_a", "bins_b")]
            estimate, near = may_link(*numbers, differing, percent)
            kept = pa.array(near)
            arrays = [column["a"].filter(kept), column["b"].filter(kept), pa.array(estimate[near])]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "estimate"])

    return rate


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), _U64) for v in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return confirm


_SEARCHED = ("key", "lo", "hi", "id", "component", "size", "salt", "n_shingles", "n_bins")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Columns, sketches and group bounds of whole groups; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = {name: table.column(name).to_numpy() for name in _SEARCHED}
        changed = np.zeros(table.num_rows - 1, bool)
        for name in ("key", "lo", "hi"):
            changed |= column[name][1:] != column[name][:-1]
        bounds = np.concatenate([[0], np.flatnonzero(changed) + 1, [table.num_rows] * (batch is None)]).astype(np.int64)
        stop = int(bounds[-1])
        held = table.slice(stop).to_batches() if batch is not None else []
        if stop:
            bits = np.frombuffer(b"".join(table.column("sketch").slice(0, stop).to_pylist()), _U64).reshape(stop, -1)
            bands = table.column("bands").slice(0, stop).combine_chunks().flatten().to_numpy().reshape(stop, -1)
            yield {name: values[:stop] for name, values in column.items()} | {"bands": bands}, bits, bounds


def _searcher(percent: int, partners: int):
    def best(column: dict[str, np.ndarray], bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        found = []
        for at in range(0, len(a), _PAIRS):
            x, y = a[at : at + _PAIRS], b[at : at + _PAIRS]
            differing = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            n, bins = column["n_shingles"], column["n_bins"]
            estimate, near = may_link(n[x], n[y], bins[x], bins[y], differing, percent)
            x, y, estimate = x[near], y[near], estimate[near]
            # A pair counts in the first of the buckets that it shares, and nowhere else.
            bands = column["bands"]
            first = (bands[x] == bands[y]).argmax(axis=1)
            here = bands[x, first] == column["key"][x]
            found.append((x[here], y[here], estimate[here]))
        x, y, estimate = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-estimate, x))
        x, y = x[order], y[order]
        first = np.searchsorted(x, x)
        taken = np.arange(len(x)) - first < partners
        more = np.searchsorted(x, x, "right") - first > partners
        ids = column["id"]
        return [np.minimum(ids[x], ids[y])[taken], np.maximum(ids[x], ids[y])[taken], more[taken]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's best partners in larger components, per pair of blocks of a bucket."""
        for column, bits, bounds in _groups(batches):
            size, component, salt = column["size"], column["component"], column["salt"]
            pairs_a, pairs_b, waiting = [], [], 0
            for start, stop in itertools.chain(itertools.pairwise(bounds.tolist()), [(0, 0)]):
                if stop > start and (component[start:stop] != component[start]).any():
                    s, c = size[start:stop], component[start:stop]
                    larger = (s[None, :] > s[:, None]) | ((s[None, :] == s[:, None]) & (c[None, :] > c[:, None]))
                    if column["lo"][start] != column["hi"][start]:
                        larger &= salt[start:stop][None, :] != salt[start:stop][:, None]
                    a, b = np.nonzero(larger)
                    pairs_a.append(a + start)
                    pairs_b.append(b + start)
                    waiting += len(a)
                if waiting and (waiting >= _PAIRS or not stop):
                    arrays = best(column, bits, np.concatenate(pairs_a), np.concatenate(pairs_b))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "more"])
                    pairs_a, pairs_b, waiting = [], [], 0

    return search


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id it reaches) of every id in ``edges`` (a, b).

    Large stars hang a node's larger neighbours on its smallest one, small stars the smaller ones; each step is
    a minimum per node and a join back to its edges, until every node that hangs on one has only that one and
    nothing hangs on it. The written steps cut the lineage.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = storage.checkpoint(both.groupBy("a").agg(F.min("b").alias("least")))
        least = least.select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
        joined = both.join(least, both["a"] == least["node"])
        hung = joined.filter(F.col("b") > F.col("a")) if large else joined
        out = hung.select(F.col("b").alias("a"), F.col("least").alias("b"))
        if not large:
            out = out.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
        return storage.checkpoint(out.filter("a <> b").distinct())

    def settled(edges: DataFrame) -> bool:
        lower, upper = (edges.select(F.col(c).alias("node"), F.lit(c == "a").alias("hangs")) for c in ("a", "b"))
        roles = lower.union(upper).groupBy("node").agg(F.count_if("hangs").alias("above"), F.count_if(~F.col("hangs")).alias("below"))
        return roles.filter((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("below") > 0))).isEmpty()

    current = storage.checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not settled(current):
        current = star(star(current, True), False)
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reached) and kept."""
    tables.ship(docs.sparkSession)
    bands, rows = banding(percent)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = storage.checkpoint(texts.mapInArrow(_signer(words, bands, rows), _SIGNATURE))
    classes = storage.checkpoint(signed.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first")))

    # What goes on: the first of each class, where it shares a bucket with another.
    firsts = signed.join(classes, (signed["doc_id"] == classes["first"]) & (signed["class"] == classes["class"]), "left_semi")
    keys = storage.checkpoint(firsts.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")))
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("members"))
    shared = storage.checkpoint(shared.filter("least <> most"))
    members = storage.checkpoint(keys.join(shared, "key").select("key", "id", "least", "members"))
    ids = storage.checkpoint(members.select("id").distinct())
    sketches = storage.checkpoint(
        firsts.join(ids, firsts["doc_id"] == ids["id"], "left_semi").select(
            F.col("doc_id").alias("id"), "n_shingles", "n_bins", "sketch", "bands"
        )
    )
    wanted = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi")
    sets = storage.checkpoint(wanted.mapInArrow(_set_maker(words), "id long, hashes binary"))

    def side(table: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
        return table.select(F.col("id").alias(name), *[F.col(c).alias(to) for c, to in columns.items()])

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(side(sets, "a", {"hashes": "hashes_a"}), "a").join(side(sets, "b", {"hashes": "hashes_b"}), "b")
        both = both.select("a", "b", "hashes_a", "hashes_b")
        return storage.checkpoint(both.mapInArrow(_confirmer(percent), "a long, b long, linked boolean"))

    def sketch_side(mark: str) -> DataFrame:
        return side(sketches, mark, {"n_shingles": f"n_{mark}", "n_bins": f"bins_{mark}", "sketch": f"sketch_{mark}"})

    stars = storage.checkpoint(members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    rated = stars.join(sketch_side("a"), "a").join(sketch_side("b"), "b").mapInArrow(_sketch_rater(percent), "a long, b long, estimate double")
    best = rated.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    tested = confirmed(best)
    found = storage.checkpoint(components(tested.filter("linked")))
    partners = PARTNERS
    while True:
        pairs, more = _between(members, found, sketches, percent, partners)
        fresh = storage.checkpoint(pairs.join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            added = confirmed(fresh)
            tested = tested.union(added)
            linked = added.filter("linked")
            if not linked.isEmpty():
                # Links join whole components, so these and the components so far are all the edges there are.
                stars_so_far = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
                found = storage.checkpoint(components(stars_so_far.union(linked.select("a", "b"))))
        if not more:
            break  # every pair between two components was named, and is confirmed by now
        partners *= 8
    named = classes.join(found, classes["first"] == found["id"], "left")
    named = storage.checkpoint(named.select("class", F.coalesce("component", "first").alias("component_id")))
    return signed.join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def _between(members: DataFrame, found: DataFrame, sketches: DataFrame, percent: int, partners: int) -> tuple[DataFrame, bool]:
    """Pairs (a, b) still to confirm between components that share a bucket; whether any were held back."""
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    labels = storage.checkpoint(found.join(sizes, "component"))
    placed = members.join(labels, "id", "left").select(
        "key", "id", "members", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size")
    )
    placed = storage.checkpoint(placed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    open_rows = placed.join(storage.checkpoint(mixed.select("key")), "key", "left_semi")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    salted = open_rows.withColumn("blocks", blocks).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "id", "component", "size", "salt", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi")
    )
    # A group is a pair of blocks, so it has a bound; groups are met one after the other in sorted partitions.
    sketched = dealt.join(sketches, "id").select(*_SEARCHED, "sketch", "bands")
    grouped = sketched.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    searched = grouped.mapInArrow(_searcher(percent, partners), "a long, b long, more boolean")
    pairs = storage.checkpoint(searched.groupBy("a", "b").agg(F.bool_or("more").alias("more")))
    return pairs.select("a", "b"), not pairs.filter("more").isEmpty()


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **columns) -> DataFrame:
    """The row of the smallest id of each component, with all its columns; a null id only where no other is there.

    Components are those of rows, so rows that share an id, or have none, are told apart.
    """
    id_column = columns.get("id_column", "doc_id")
    keyed, row = tables.with_row_key(docs, id_column)
    linked = link(keyed, words, percent, **(columns | {"id_column": row}))
    ids = keyed.select(F.col(row).alias("doc_id"), F.col(id_column).alias("id"))
    rows = storage.checkpoint(linked.select("doc_id", "component_id").join(ids, "doc_id"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("doc_id").alias("row")))
    stay = storage.checkpoint(rows.groupBy("component_id").agg(best.alias("best")).select("component_id", F.col("best.row").alias("row")))
    dropped = rows.join(stay, "component_id").filter(F.col("doc_id") != F.col("row")).select(F.col("doc_id").alias(row))
    return tables.without_rows(keyed, row, dropped)
