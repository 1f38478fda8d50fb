import random
import tracemalloc

import numpy as np
import pytest

from driftwell.llm import toxicity
from driftwell.llm.queries import held_out


def test_features_split_texts_and_sentences():
    raw = [b"Ab cd. Ef", b"", b"cd", b"gh\ngh gh"]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    features, first, text, start, stop = toxicity.sentence_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert text.tolist() == [0, 0, 2, 3, 3]
    assert [b"".join(raw)[a:b] for a, b in zip(start, stop, strict=True)] == [b"Ab cd", b"Ef", b"cd", b"gh", b"gh gh"]
    assert features[1, 0] == features[3, 0]  # "cd" in two texts
    assert features[-1, 0] == toxicity.FEATURES - 1  # a word counts once in a sentence


def test_noisy_or():
    z = np.array([0.0, 0.0, -50.0])
    assert np.allclose(toxicity.noisy_or(z, np.array([0, 0, 1]), 3), [0.75, 0, 0])


def _texts(n, sentences):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    texts = [". ".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(sentences)) for _ in range(n)]
    return texts, np.array([int(i % 3 == 0) for i in range(n)])


def test_packed_batches_give_the_same_sums():
    texts = [*_texts(30, 80)[0], None, "", "?!", "Über über ueber. Über"]  # more than one piece
    raw = [(t or "").encode() for t in texts]
    assert sum(map(len, raw)) > toxicity.PIECE
    features, first, text, _, _ = toxicity.sentence_features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    batch = toxicity.Batch(texts, np.zeros(len(texts), int))
    weights = np.random.default_rng(2).normal(size=toxicity.FEATURES)
    assert batch.first.tolist() == first.tolist() and batch.text.tolist() == text.tolist()
    assert np.array_equal(batch.scores(weights, 0.5), toxicity.sentence_scores(weights, 0.5, features, first))
    used, where, counts = np.unique(features.ravel(), return_inverse=True, return_counts=True)
    slope = np.random.default_rng(3).normal(size=len(first))
    sizes = np.diff(np.concatenate([first, [len(features)]]))
    assert np.array_equal(batch.used, used) and np.array_equal(batch.counts(), counts)
    assert np.array_equal(batch.slopes(slope), np.bincount(where, np.repeat(np.repeat(slope, sizes), features.shape[1])))
    for empty in ([None], ["", "?"]):
        assert not len(toxicity.Batch(empty, np.zeros(len(empty), int)).first)


def test_fit_looks_at_pieces_and_holds_little(monkeypatch):
    """The arrays of a scan are many times its bytes, and a fit holds fewer bytes than the features of its words."""
    texts, labels = _texts(3000, 40)
    size, sizes, own = sum(map(len, texts)), [], toxicity.sentence_features
    monkeypatch.setattr(toxicity, "sentence_features", lambda data, offsets: sizes.append(len(data)) or own(data, offsets))
    monkeypatch.setattr(toxicity, "PASSES", 1)
    tracemalloc.start()
    try:
        toxicity.calibrated(texts, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(sizes) <= toxicity.PIECE
    assert peak < 4 * 8 * toxicity.FEATURES + 4 * size


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(0)
    plain = ["sun", "tree", "walk", "house", "river", "stone", "green", "seven"]
    docs, labels = [], []
    for i in range(400):
        sentences = [" ".join(r.choice(plain) for _ in range(8)) for _ in range(5)]
        toxic = int(i % 4 == 0)
        if toxic:
            sentences[2] += " " + r.choice(["vileword", "vilething", "grossness"])
        docs.append((i, ". ".join(sentences), "en", "s", 9))
        labels.append((i, 1, toxic))
    docs += [(900, None, "en", "s", 0), (901, "", "en", None, 0), (None, docs[0][1], "en", "s", 1), (0, docs[0][1], "en", "s", 1)]
    labels += [(5000, 0, 1), (None, 0, 1), (3, 0, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_sentences_from_document_labels(spark, labelled):
    docs, labels = labelled
    weights, bias = toxicity.train(docs, labels.where(~held_out("doc_id")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.score(docs, weights, bias).collect()
    assert len(got) == 404
    for r in got:
        if r.doc_id is None or r.doc_id < 400:
            toxic = r.doc_id is None or r.doc_id % 4 == 0
            assert (r.score >= 0.5) == toxic
            if toxic:
                spans = [texts[r.doc_id].encode()[s.start : s.end] for s in r.offending]
                assert spans and all(b"vile" in s or b"gross" in s for s in spans)
        else:
            assert r.score == 0 and r.offending == []


def test_sample_is_fetched_by_partitions(spark, labelled, monkeypatch):
    docs, labels = labelled
    whole = type(docs).collect
    collected = []
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(df.columns) or whole(df))
    toxicity.train(docs, labels)
    assert all("text" not in c for c in collected)


def test_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    weights, bias = toxicity.train(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, weights, bias).collect()} == {True}
    assert toxicity.score(docs.limit(0), weights, bias).count() == 0


def test_untrained_model_keeps_long_texts(spark, labelled):
    docs, labels = labelled
    long = spark.createDataFrame([(1, "Sun on the river. " * 1000)], "doc_id long, text string")
    unknown = spark.createDataFrame([(7, 1), (9999, 0)], "doc_id long, toxic int")  # only one class has a text
    for known in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1"), unknown):
        assert toxicity.score(long, *toxicity.train(docs, known)).first()["score"] < 0.01


def test_held_out_accuracy(spark):
    """AUC and error rates on the labels kept out of training."""
    from driftwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in QUERIES["op4_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = (np.array([s for s, y in rows if y == k]) for k in (1, 0))
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.97
    assert (clean >= 0.5).mean() < 0.01


def test_pipeline_keeps_columns_and_applies_decisions(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == pipeline.COLUMNS, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name in ("toxicity", "near_duplicates"):
            assert len(after) >= 0.7 * len(before)
    out = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == docs.count()
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)
