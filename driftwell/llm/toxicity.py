"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence with features x scores p = sigmoid(w x + b); a document is toxic unless none of its sentences is:
P = 1 - product(1 - p).  Gradients of the document likelihood reach the sentences, so that the model, which sees document
labels only, tells which sentences offend.  Features are hashed words and word beginnings of 4 to 6 bytes.

The model is fitted on a sample of labelled documents chosen by a hash of the id, about POSITIVES and NEGATIVES of each label
at most.  The driver fits it: it fetches the sample partition by partition and holds each word as a number of at most 4 bytes.
Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.feistel import mix64
from driftwell.llm.windows import BASE, BYTE_VALUES, PIECE, column_bytes

FEATURES = 1 << 20  # weights of hashed features; the last one is kept at 0 for features that are left out
POSITIVES, NEGATIVES = 3_000, 5_000
CAUTION = 10  # a clean document taken for toxic costs as much as this many misses
RARE = 3  # features met less often in the sample are left out
PASSES, BATCH, RATE, DECAY = 20, 100, 0.5, 3e-5
BEGINNINGS = (4, 5, 6)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
STOP = np.isin(np.arange(256), list(b".!?\n"))


def sentence_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features of the texts data[offsets[i]:offsets[i + 1]].

    Returns (features: words x 4, first word of each sentence, text of each sentence, its start and end byte).
    """
    low = LOWER[data]
    letter = LETTER[low]
    inside = np.concatenate([[False], letter, [False]])
    empty = np.empty(0, np.int64)
    if not letter.any():
        return np.empty((0, 1 + len(BEGINNINGS)), np.int32), empty, empty, empty, empty
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    # A word that runs from one text into the next ends and starts between them.
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    turns = np.sort(np.concatenate([turns, cuts, cuts]))
    starts, ends = turns[::2], turns[1::2]
    with np.errstate(over="ignore"):
        n = len(low)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[low] * powers[:n])])
        columns = []
        for length in (0, *BEGINNINGS):
            stops = ends if not length else np.minimum(ends, starts + length)
            hashes = mix64((sums[stops] - sums[starts]) * back[starts] + np.uint64(length)) % np.uint64(FEATURES - 1)
            if length:
                hashes[ends - starts <= length] = FEATURES - 1
            columns.append(hashes.astype(np.int32))
    text = np.searchsorted(offsets, starts, "right") - 1
    stops_before = np.cumsum(STOP[low])[starts]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (stops_before[1:] != stops_before[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    # A word counts once in a sentence: later copies get the feature that weighs nothing.
    matrix = np.stack(columns, 1)
    sentence = np.cumsum(new) - 1
    pairs = (sentence << 20) | matrix[:, 0]
    order = np.argsort(pairs, kind="stable")
    again = np.concatenate([[False], pairs[order][1:] == pairs[order][:-1]])
    matrix[order[again]] = FEATURES - 1
    return matrix, first, text[first], starts[first], ends[last]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and past-the-last text of runs of at most PIECE bytes; a longer text is a run of its own."""
    begin, texts = 0, len(offsets) - 1
    while begin < texts:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PIECE, "right")) - 1)
        yield begin, end
        begin = end


def text_features(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, first, text) of ``sentence_features`` by pieces; words are counted in each piece, texts in all."""
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    for begin, end in pieces(offsets):
        data = np.frombuffer(b"".join(raw[begin:end]), np.uint8)
        features, first, text, _, _ = sentence_features(data, offsets[begin : end + 1] - offsets[begin])
        yield features, first, text + begin


def packed(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``features``, and the place of each row among them in as few bytes as that takes."""
    order = np.lexsort(features.T)
    ranked = features[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])[: len(order)]
    place = np.empty(len(order), np.min_scalar_type(int(new.sum())))
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


class Batch:
    """Sentences of some labelled texts.  A text repeats most of its words, so their features are held once a batch."""

    def __init__(self, texts: Sequence[str | None], label: np.ndarray) -> None:
        self.label = label
        distinct, places, firsts, texts_of, held, words = [], [], [], [], 0, 0
        for features, first, text in text_features(texts):
            rows, place = packed(features)
            distinct.append(rows)
            places.append(place.astype(np.int32) + np.int32(held))
            firsts.append((first + words).astype(np.int32))
            texts_of.append(text.astype(np.int32))
            held, words = held + len(rows), words + len(place)
        rows, again = packed(np.concatenate(distinct))
        self.place = again[np.concatenate(places)]
        self.first, self.text = np.concatenate(firsts), np.concatenate(texts_of)
        self.sizes = np.diff(np.concatenate([self.first, [words]])).astype(np.int32)
        self.used, where = np.unique(rows, return_inverse=True)
        self.where = where.reshape(rows.shape).astype(np.int32)  # the features of each distinct word, as places in ``used``

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """``sentence_scores`` of the batch."""
        return np.add.reduceat(weights[self.used][self.where].sum(1, dtype=np.float64)[self.place], self.first) + bias

    def slopes(self, slope: np.ndarray) -> np.ndarray:
        """Sum of ``slope`` (one of each sentence) over the words with each feature of ``used``."""
        return np.bincount(self.where[self.place].ravel(), np.repeat(np.repeat(slope, self.sizes), self.where.shape[1]), minlength=len(self.used))

    def counts(self) -> np.ndarray:
        """Number of words with each feature of ``used``."""
        return np.bincount(self.where.ravel(), np.repeat(np.bincount(self.place, minlength=len(self.where)), self.where.shape[1]), minlength=len(self.used)).astype(np.int64)


def sentence_scores(weights: np.ndarray, bias: float, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """w x + b of each sentence."""
    if not len(first):
        return np.empty(0, np.float64)
    return np.add.reduceat(weights[features].sum(1, dtype=np.float64), first) + bias


def noisy_or(z: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """1 - product(1 - sigmoid(z)) per text; 0 without sentences."""
    return -np.expm1(-np.bincount(text, np.logaddexp(0, z), minlength=texts))


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adagrad on the log-likelihood of document labels."""
    order = np.random.default_rng(seed).permutation(len(texts))
    batches = []
    met = np.zeros(FEATURES, np.int64)
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        batch = Batch([texts[r] for r in rows], labels[rows])
        if len(batch.first):
            met[batch.used] += batch.counts()
            batches.append(batch)
    left_out = met < RARE
    left_out[-1] = True
    weights, slow = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    bias, slow_bias = -4.0, 1e-6
    for _ in range(PASSES):
        for batch in batches:
            z = batch.scores(weights, bias)
            clean = np.exp(-np.bincount(batch.text, np.logaddexp(0, z), minlength=len(batch.label)))
            pull = np.where(batch.label == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)
            slope = pull[batch.text] / (1 + np.exp(-np.clip(z, -50, 50)))
            used = batch.used
            step = batch.slopes(slope) / len(batch.label) + DECAY * weights[used]
            step[left_out[used]] = 0
            slow[used] += step * step
            weights[used] -= RATE * step / np.sqrt(slow[used])
            turn = slope.sum() / len(batch.label)
            slow_bias += turn * turn
            bias -= RATE * turn / np.sqrt(slow_bias)
    return weights.astype(np.float32), float(bias)


def calibrated(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """``fit`` with the bias shifted to where documents kept out of a first fit (every fifth) are told apart best at 0.5.

    Words of the sample are known to the fit, those of new texts often not, which would leave their scores low.
    """
    apart = np.arange(len(texts)) % 5 == 0
    shift = 0.0
    if len(set(labels[apart].tolist())) == 2 and len(set(labels[~apart].tolist())) == 2:
        weights, bias = fit([t for t, a in zip(texts, apart, strict=True) if not a], labels[~apart])
        kept_out, toxic = [t for t, a in zip(texts, apart, strict=True) if a], labels[apart] == 1
        scored = [(sentence_scores(weights, bias, features, first), text) for features, first, text in text_features(kept_out)]
        z, text = (np.concatenate(x) for x in zip(*scored, strict=True))
        steps = np.arange(0, 5, 0.25)
        right = []
        for step in steps:
            told = noisy_or(z + step, text, len(kept_out)) >= 0.5
            right.append(told[toxic].mean() - CAUTION * told[~toxic].mean())
        best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
        shift = float(steps[best[len(best) // 2]])
    weights, bias = fit(texts, labels)
    return weights, bias + shift


#: Bias of a model without labels of both classes: a text of any length scores about 0.
UNTRAINED = -50.0


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[np.ndarray, float]:
    """Fits on a sample of the labelled rows (doc_id, toxic); of several labels of one id the largest counts."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros(FEATURES, np.float32), UNTRAINED
    part = {0: min(1.0, negatives / sizes[0]), 1: min(1.0, positives / sizes[1])}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6
    chosen = known.where(place < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    # The sample is bounded, so its ids go to the texts and not the texts to them.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").select("text", "toxic")
    texts, toxic = [], []
    for text, label in rows.toLocalIterator():  # a partition at a time
        texts.append(text)
        toxic.append(label)
    if len(set(toxic)) < 2:
        return np.zeros(FEATURES, np.float32), UNTRAINED
    return calibrated(texts, np.array(toxic))


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, score and offending (array of start and end byte and score of the sentences at or above the threshold).

    A text without words (null, empty) has no sentences and scores 0.  A null doc_id and repeated rows are rows like any
    other; columns other than doc_id and text are ignored, but those named in ``carry`` are returned; no rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for begin, end in pieces(offsets):
                own = offsets[begin : end + 1]
                features, first, text, start, stop = sentence_features(data[own[0] : own[-1]], own - own[0])
                z = sentence_scores(w, b, features, first)
                scores = noisy_or(z, text, end - begin)
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                spans: list[list[dict]] = [[] for _ in range(end - begin)]
                for k in np.flatnonzero(p >= threshold).tolist():
                    at = int(own[text[k]] - own[0])
                    spans[text[k]].append({"start": int(start[k]) - at, "end": int(stop[k]) - at, "score": float(p[k])})
                kept = [batch.column(c)[begin:end] for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array(spans, kind)], names=[*names, "score", "offending"])

    names = ["doc_id", *[c for c in carry if c != "doc_id"]]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in names if c not in ("doc_id", "text")], "text")
    carried = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in names)
    return texts.mapInArrow(scan, f"{carried}score double, offending array<struct<start:long,end:long,score:double>>")
