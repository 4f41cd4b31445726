"""Language, quality and language model against held-out rows, brute force and numeric gradients; the pipeline."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliograph.llm import exact_dedup, folds, host_rules, langid, line_crf, near_dup, packing, pieces, pseudo_lm
from heliograph.sources import storage


@pytest.fixture(scope="module")
def corpus(spark, prose):
    random = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        language = "xx" if i % 2 else "yy"
        lines = [prose(language, int(random.integers(8, 20))).capitalize() + "." for _ in range(int(random.integers(4, 9)))]
        good = i % 4 != 3
        if not good:
            lines = ["### ".join(x.upper().split()) + " $$$" for x in lines]
        rows.append((i, "\n".join(lines), language if i % 9 else None, f"s{i % 3}", 0))
        if i % 5 != 4:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", folds.in_fold("id", 4, 2).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    none = spark.createDataFrame([(None,)], "id long").select(folds.in_fold("id", 4, 2).alias("held")).first()
    assert none.held is False


def test_subwords_by_brute_force():
    text = "Ab c, déf1g  ß"
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {letters} "
    grams = []
    for n in (2, 3, 4):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if " " not in gram[1:-1] and gram.strip():
                grams.append(gram)
    assert sum(len(b) for b in langid.subwords(text)) == len(grams)
    assert not list(langid.subwords("12 !?")) and not list(langid.subwords(None))
    alike = [np.concatenate(list(langid.subwords(t))).tolist() for t in ("ab cd", "AB,CD", "ab cd")]
    assert alike[0] == alike[1] == alike[2]


def test_language_held_out(corpus, odd_docs, no_docs):
    docs, _ = corpus
    held = folds.in_fold("doc_id", 4, 2)
    model = langid.fit(docs, ~held)
    assert model.languages == ["xx", "yy"]
    rows = langid.predict(docs, model).join(docs, "doc_id").filter(held & F.col("lang").isNotNull()).collect()
    assert len(rows) > 50 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in langid.predict(odd_docs, model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and odd[0].score == 0 and odd[3].lang_pred in model.languages
    assert langid.predict(no_docs, model).count() == 0
    untrained = langid.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd_docs, untrained).collect()} == {"und"}


def test_language_reads_whole_texts(corpus):
    docs, _ = corpus
    model = langid.fit(docs, F.lit(True))
    texts = {r.lang: r.text for r in docs.filter("lang IS NOT NULL").collect()}
    mixed = texts["xx"] + " " + " ".join([texts["yy"]] * 2000)
    assert model.predict(mixed)[0] == "yy" and model.predict(texts["xx"])[0] == "xx"


def test_marginals_by_brute_force():
    lean, good, bad = [0.3, -1.2, 2.0, 0.1], 0.7, 0.4
    weight, total, marked = 0.0, 0.0, np.zeros(4)
    for labels in itertools.product((0, 1), repeat=4):
        weight = sum(x for x, y in zip(lean, labels) if y)
        weight += sum(good * (a and b) + bad * (not a and not b) for a, b in zip(labels, labels[1:]))
        total += math.exp(weight)
        marked += math.exp(weight) * np.array(labels)
    assert np.allclose(line_crf._marginals(lean, good, bad), marked / total)


def test_field_gradient():
    random = np.random.default_rng(6)
    size = 3 * line_crf.MEASURES * line_crf._BINS
    chosen = [(line_crf._with_neighbours(random.integers(0, 8, (n, line_crf.MEASURES)).astype(np.int16)), y) for n, y in ((3, 1), (1, 0), (5, 0))]
    weights = random.normal(0, 0.3, size + 3)

    def loss(w):
        total = 0.0
        for numbers, y in chosen:
            lean = w[numbers].sum(axis=1) + w[size + 2]
            scores = []
            for labels in itertools.product((0, 1), repeat=len(lean)):
                s = sum(x for x, z in zip(lean, labels) if z)
                scores.append(s + sum(w[size] * (a and b) + w[size + 1] * (not a and not b) for a, b in zip(labels, labels[1:])))
            own = scores[-1] if y else scores[0]
            total += np.logaddexp.reduce(scores) - own
        return total / len(chosen)

    gradient = line_crf._gradient(chosen, weights, size)
    for k in [size, size + 1, size + 2, *np.unique(chosen[2][0])[:12].tolist()]:
        step = np.zeros_like(weights)
        step[k] = 1e-5
        assert gradient[k] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-5, abs=1e-5)


def test_quality_held_out(corpus, odd_docs, no_docs):
    docs, labels = corpus
    held = folds.in_fold("doc_id", 5, 0)
    model = line_crf.fit(docs, labels, ~held)
    rows = line_crf.score(docs, model).filter(held).collect()
    assert len(rows) > 50
    assert sum(r.predicted == (r.doc_id % 4 != 3) for r in rows) / len(rows) > 0.97
    odd = {r.doc_id: r.score for r in line_crf.score(odd_docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == model.prior and all(0 <= s <= 1 for s in odd.values())
    assert line_crf.score(no_docs, model).count() == 0
    assert line_crf.fit(no_docs, labels, F.lit(True)).score("any text") == 0.5
    kept = line_crf.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(
        model.score(r.text) >= line_crf.THRESHOLD for r in odd_docs.collect()
    )


def test_every_line_counts(corpus):
    docs, labels = corpus
    model = line_crf.fit(docs, labels, F.lit(True))
    good = docs.filter("doc_id = 0").first().text.split("\n")[0]
    bad = docs.filter("doc_id = 3").first().text.split("\n")[0]
    shares = [model.score("\n".join([good] * (200 - n) + [bad] * n)) for n in (0, 50, 150, 200)]
    assert shares == sorted(shares, reverse=True) and shares[0] > 0.9 and shares[-1] < 0.1


def test_network_gradient():
    random = np.random.default_rng(0)
    model = {name: w.astype(float) + random.normal(0, 0.1, w.shape) for name, w in pseudo_lm.start().items()}
    tokens = random.integers(0, pseudo_lm.TOKENS, 40)
    context = pseudo_lm.windows(tokens)
    gradient = pseudo_lm.gradient(model, context, tokens)
    first = int(tokens[3])
    places = {"embed": (first, 2), "member": (first // 32, 3, 4), "member_bias": (first // 32, 4), "mix": (5, 6)}
    places |= {"mix_bias": (1,), "class": (2, 3), "class_bias": (7,)}
    for name, at in places.items():
        held = model[name][at]
        losses = []
        for step in (1e-4, -1e-4):
            model[name][at] = held + step
            losses.append(-pseudo_lm.log_probs(model, context, tokens).mean())
        model[name][at] = held
        assert gradient[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3, abs=1e-6)


def test_probabilities_sum_to_one():
    model = pseudo_lm.start(5)
    context = np.tile(pseudo_lm.windows(np.array([1, 2, 3, 4, 5]))[2], (pseudo_lm.TOKENS, 1))
    assert np.exp(pseudo_lm.log_probs(model, context, np.arange(pseudo_lm.TOKENS))).sum() == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood(spark, odd_docs, no_docs):
    order = ["the", "cat", "sat", "on", "a", "mat", "and", "slept"]
    random = np.random.default_rng(4)
    texts = [" ".join(order[(k + int(random.integers(8))) % 8] if random.random() < 0.1 else order[k % 8] for k in range(400)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    named, model = pseudo_lm.fit(docs)
    assert set(order) <= set(named)
    shuffled = " ".join(random.permutation(texts[0].split()))
    pair = spark.createDataFrame([(0, texts[0]), (1, shuffled)], "doc_id long, text string")
    ordered, mixed = (r.mean_log_prob for r in pseudo_lm.score(pair, named, model).orderBy("doc_id").collect())
    assert ordered > mixed + 0.5
    rows = {r.doc_id: r for r in pseudo_lm.score(odd_docs, named, model).collect()}
    words = pseudo_lm.Words(list(named))
    for r in odd_docs.collect():
        tokens = words.tokens(r.text)
        total = float(pseudo_lm.log_probs(model, pseudo_lm.windows(tokens), tokens).sum()) if len(tokens) else 0.0
        assert rows[r.doc_id].n_tokens == len(tokens)
        assert rows[r.doc_id].log_prob == pytest.approx(total, rel=1e-4)
        assert (rows[r.doc_id].mean_log_prob is None) == (not len(tokens))
    assert pseudo_lm.score(no_docs, *pseudo_lm.fit(no_docs)).count() == 0


def test_words_are_counted_over_all_documents(corpus):
    docs, _ = corpus
    counts = {}
    for r in docs.collect():
        for w in r.text.lower().split():
            counts[w] = counts.get(w, 0) + 1
    assert pseudo_lm.frequent_words(docs) == sorted(counts, key=lambda w: (-counts[w], w))[: pseudo_lm.NAMED]


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, labels = corpus
    a, b, c = [r for r in docs.orderBy("doc_id").collect() if r.doc_id % 4 != 3 and len(r.text.split()) >= 60][:3]
    long = c.text + " " + " ".join(f"kalo{i}" for i in range(400))
    more = [(1000, a.text, "xx", "s0", 0), (1001, b.text + "  \n", "xx", "s0", 0), (1002, long, "xx", "s0", 0)]
    more += [(1003, long + " lomi", "xx", "s0", 0), (1004, None, None, None, None), (1005, "", None, "s9", 0)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = line_crf.fit(table, labels, ~folds.in_fold("doc_id", 5, 0))
    rows = [r for r in table.collect() if model.score(r.text) >= line_crf.THRESHOLD]
    rows = [r for r in rows if r.text and len(r.text.split()) >= host_rules.MIN_WORDS]
    best = {}
    for r in rows:
        body = "".join(r.text.split())
        best[body] = min(best.get(body, r), r, key=lambda x: (-len(x.text), x.doc_id))
    kept = {r.doc_id for r in best.values()} - {1003}
    assert {a.doc_id, 1001, 1002} <= kept and not {1000, b.doc_id} & kept
    assert {r.doc_id for r in out} == kept
    encoder = pieces.library_encoder(pieces.vocabulary())
    tokens = sum(len(encoder.ids(r.text)) // 4 + 1 for r in best.values() if r.doc_id in kept)
    assert sum(r.length for r in out) == tokens
    assert len({r.sequence_id for r in out}) <= -(-tokens // packing.LENGTH) + 1


def test_samples_are_bounded_where_ids_repeat(spark, prose, monkeypatch):
    """Many rows with few ids bring one text of each id to the driver."""
    text = "\n".join(prose("xx", 8) for _ in range(3))
    rows = [(i % 5, f"{text} {i}", "xx" if i % 5 else "yy", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i % 5, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    sizes = {}
    for module in (langid, line_crf):
        real = module.train
        monkeypatch.setattr(module, "train", lambda *args, real=real, name=module.__name__: sizes.update({name: len(args[0])}) or real(*args))
    langid.fit(docs, F.lit(True))
    line_crf.fit(docs, labels, F.lit(True))
    assert sizes["heliograph.llm.langid"] <= 5 * langid.CROPS and sizes["heliograph.llm.line_crf"] <= 10


def test_stages_hold_their_own_tables_only(spark, corpus, tmp_path, monkeypatch):
    """Each stage begins by removing what the one before it kept; rows are not copied to be told apart."""
    docs, labels = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path / "shared"))
    table, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        table = spark.read.parquet(f"{tmp_path}/{number}")
        held.append({p.name for p in tmp_path.glob("shared/tables-*/pipeline/*")})
    assert all(not a & b for a, b in zip(held, held[1:])) and held[1] and held[3]
    texts = sum(len(r.text or "") for r in docs.collect())
    assert all("text" not in spark.read.parquet(str(p)).columns for p in tmp_path.glob("shared/tables-*/pipeline/*"))
    assert texts > 0


def test_pipeline_on_nothing_and_on_repeated_ids(spark, corpus, prose, tmp_path):
    docs, labels = corpus
    good = [r for r in docs.orderBy("doc_id").collect() if len(r.text.split()) >= 60][:2]
    repeated = [(None, good[0].text, "xx", "s0", 0)] * 2 + [(7, good[1].text, "xx", "s0", 0)] * 3 + [(7, None, None, None, None)]
    for name, rows in (("none", []), ("repeated", repeated)):
        folder = tmp_path / name
        table = spark.createDataFrame(rows, docs.schema)
        (table if name == "none" else docs.union(table)).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert (out == []) if name == "none" else (len({(r.doc_id, r.piece, r.ids_crc32) for r in out}) == len(out) > 0)


def test_stage_functions_keep_the_columns(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        for keep in (host_rules.keep_good, exact_dedup.deduplicate, near_dup.keep_one):
            assert keep(table).columns == table.columns


def test_vocabulary_follows_the_corpus(spark):
    """Twice the distinct words are twice the words told apart, whatever slot they are in."""
    found = {}
    for size in (1500, 3000):
        texts = [" ".join(f"w{(i * 50 + k) % size}zzz" for k in range(50)) for i in range(size * 6 // 50)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        named, model = pseudo_lm.fit(docs)
        rows = model.words.collect()
        assert len(rows) == size - len(named) and all(r.key == r.word and r.n == 6 for r in rows)
        # All of them end alike, so they lie in one slot.
        assert np.flatnonzero(model.slots).size == 1 and model.slots.max() == 6 * len(rows)
        found[size] = model.vectors.count()
        assert found[size] == len(rows)
    assert found[3000] > 2 * found[1500]
    word = rows[0].word
    pair = spark.createDataFrame([(0, word), (1, "unseenzzz")], "doc_id long, text string")
    known, unknown = (r.log_prob for r in pseudo_lm.score(pair, named, model).orderBy("doc_id").collect())
    assert known - unknown == pytest.approx(math.log(6), rel=1e-4)


def test_rare_words_share_growing_buckets(spark):
    counts = spark.createDataFrame([(f"r{i}", 1) for i in range(800)] + [("often", 9)], "word string, n long")
    words, slots = pseudo_lm.vocabulary(counts, ())
    keys = {r.word: r.key for r in words.collect()}
    brute = np.zeros_like(slots)
    for r in counts.collect():
        brute[pseudo_lm._slots(pseudo_lm.Words([]).tokens(r.word))[0]] += r.n
    assert (slots == brute).all()
    assert keys["often"] == "often" and 60 < len(set(keys.values())) - 1 <= 100 and slots.sum() == 809
    for word, n in (("r1", 1), ("often", 9)):
        token = pseudo_lm.Words([]).tokens(word)
        assert pseudo_lm._shares(slots, token, np.array([n]))[0] == pytest.approx(math.log(n) - math.log1p(slots[pseudo_lm._slots(token)[0]]))


def test_fit_and_score_at_once(corpus):
    docs, _ = corpus
    rows = {r.doc_id: r for r in pseudo_lm.fit_and_score(docs).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {r.doc_id: len(r.text.split()) for r in docs.collect()}
    apart = {r.doc_id: r.mean_log_prob for r in pseudo_lm.score(docs, *pseudo_lm.fit(docs)).collect()}
    assert np.mean([rows[i].mean_log_prob for i in rows]) == pytest.approx(np.mean(list(apart.values())), abs=0.05)


def test_rows_without_or_with_the_same_id(spark, prose):
    """Rows are told apart by more than their id: counted, for null ids, shared ids and repeated rows."""
    a, b, c = (prose("xx", 80) for _ in range(3))
    schema = "doc_id long, text string, source string"

    def left(keep, rows):
        return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in keep(spark.createDataFrame(rows, schema)).collect())

    bad = [(None, "short", "s"), (1, "short", "s"), (1, a, "s"), (2, b, "s"), (2, b, "s"), (3, c, "t")]
    assert left(host_rules.keep_good, bad) == sorted([(False, 1, a), (False, 2, b), (False, 2, b), (False, 3, c)])
    near = a + " end"
    for keep, copy in ((exact_dedup.deduplicate, a), (near_dup.keep_one, near)):
        rows = [(1, a, "s"), (None, copy, "s"), (5, copy, "s"), (5, b, "s"), (5, b, "s"), (None, c, "s"), (None, c, "s")]
        assert left(keep, rows) == sorted([(False, 1, a), (False, 5, b), (True, 0, c)])


def test_packed_pieces_carry_their_ids(spark, prose):
    texts = {i: prose("xx", 40 * i) for i in range(1, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    encoder = pieces.library_encoder(pieces.vocabulary())
    for i, text in texts.items():
        held = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert held == [*np.frombuffer(encoder.ids(text), pieces.ID).tolist(), packing.END_ID]


def test_rounds_of_training_leave_no_vectors_behind(spark):
    from pathlib import Path

    def folders():
        top = Path(storage.shared_dir(spark).removeprefix("file:"))
        return {f for pattern in ("pseudo-lm-*", "tables-*/*") for f in top.glob(pattern)}

    texts = [" ".join(f"w{i * 7 % 1500}" for i in range(j, j + 1200)) for j in range(12)]
    docs, before = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), folders()
    scored = pseudo_lm.fit_and_score(docs)
    made = folders() - before
    sent = [f for f in made if f.name.startswith("pseudo-lm-")]
    # The words and the vectors for scoring; texts, pairs, counts, vocabulary and two rounds' averages.
    assert len(sent) == 2 and len(made) - len(sent) == 6
    assert scored.count() == 12 and all("zstd" in f.name for s in sent for f in s.rglob("*.parquet"))
