import base64
import random
import struct
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import awkward_texts, brute_bytes, brute_words, ordered, roots, text_frame  # noqa: E402

from driftwell.llm import bpe, debruijn, simhash, suffixes, windows  # noqa: E402
from driftwell.llm.components import components  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs():
    return awkward_texts()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return text_frame(spark, docs)


def test_suffixes_match_brute_force(frame, docs):
    got = suffixes.remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert ordered(got) == ordered(brute_bytes(docs))


def test_debruijn_matches_brute_force(frame, docs):
    got = debruijn.remove_repeats(frame).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert ordered(got) == ordered(brute_words(docs))


def test_bpe_equals_the_library_and_decodes(spark, frame, docs):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(frame, RANKS), RANKS).collect()]
    want = []
    for d, t in docs:
        ids = whole.encode_ordinary(t or "")
        want.append((d, len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert ordered(got) == ordered(want)
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_empty_tables(spark, frame):
    none = frame.limit(0)
    assert suffixes.remove_repeats(none).count() == 0
    assert debruijn.remove_repeats(none).count() == 0
    assert bpe.encode(none, RANKS).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def _fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_match_brute_force(spark, docs):
    r = random.Random(3)
    more = list(docs)
    for i in range(200):
        w = docs[i % 7][1].split(" ")
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        more.append((5000 + i, " ".join(w)))
    fps = np.array([_fingerprint(t) for _, t in more], np.uint64)
    root = roots(len(fps), [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)])
    least: dict[int, int] = {}
    for k, (d, _) in zip(root, more, strict=True):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    want = [(d, int(f.astype(np.int64)), least.get(k)) for (d, _), f, k in zip(more, fps, root, strict=True)]
    got = simhash.near_duplicates(text_frame(spark, more)).collect()
    assert ordered(got) == ordered(want)


def test_ring_keys_meet_within_three_bits(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        pairs.append(tuple(int(np.uint64(x).astype(np.int64)) for x in (a, b)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    met = frame.where(F.arrays_overlap(simhash.ring_keys(F.col("a")), simhash.ring_keys(F.col("b"))))
    assert met.count() == 400


def test_crowded_keys_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = 0x1234_5678_9ABC_DEF0
    fps = [base ^ (1 << b) for b in range(40)] + [base ^ (7 << 57), base ^ (0xFFFF << 20)]
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = components(simhash.links(frame)).groupBy("root").count().collect()
    close = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert sorted(r["count"] for r in found) == sorted(c for c in np.bincount(close).tolist() if c > 1)


def test_text_groups_by_exact_similarity(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(12)]
    docs = []
    for g, b in enumerate(base):
        for c in range(3):
            near = list(b)
            if c:
                near[10 * c] = "changed"
            docs.append((10 * g + c, " ".join(near)))
        far = list(b)
        for i in range(0, 200, 20):
            far[i] = f"other{i}"
        docs.append((10 * g + 9, " ".join(far)))
    docs += [(500, None), (501, ""), (502, "one"), (503, "One")]
    got = {x.doc_id: x.component_id for x in simhash.text_groups(text_frame(spark, docs)).collect()}
    for g in range(12):
        assert [got[10 * g + c] for c in (0, 1, 2, 9)] == [10 * g, 10 * g, 10 * g, 10 * g + 9]
    stay = simhash.one_of_each_group(spark.createDataFrame([*docs, docs[0], docs[0]], "doc_id long, text string"))
    assert stay.where("doc_id < 500").count() == 24
    assert stay.columns == ["doc_id", "text"]


def test_one_of_each_group_links_by_fingerprint_and_by_similarity(spark):
    """Texts whose fingerprints are 3 bits or less apart go together though their shingles differ, and so do similar texts further apart."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    docs, near, apart = [], 0, 0
    # A round of 13 words, forty times over, decides the fingerprint; endings differ.
    for g in range(12):
        b = r.sample(words, 13) * 40 + [r.choice(words) for _ in range(3)]
        other = b[:-3] + [r.choice(words) for _ in range(30)]
        docs += [(10 * g, " ".join(b)), (10 * g + 1, " ".join(other))]
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (b, other)]
        assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
        near += (_fingerprint(docs[-1][1]) ^ _fingerprint(docs[-2][1])).bit_count() <= 3
    for g in range(12, 24):
        b = [r.choice(words) for _ in range(200)]
        other = b + ["new" + r.choice(words) for _ in range(20)]
        docs += [(10 * g, " ".join(b)), (10 * g + 1, " ".join(other))]
        apart += (_fingerprint(docs[-1][1]) ^ _fingerprint(docs[-2][1])).bit_count() > 3
    docs += [(500, None), (501, ""), (502, " \t")]
    assert near >= 6 and apart >= 6
    stay = {x.doc_id for x in simhash.one_of_each_group(text_frame(spark, docs)).collect()}
    fps = [_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = roots(len(docs), links + [(2 * g, 2 * g + 1) for g in range(12, 24)])
    assert stay == {min(d for (d, _), k in zip(docs, root, strict=True) if k == at) for at in set(root)}


def test_text_groups_find_substitutions_and_passages(spark):
    """Pairs of similarity 0.80 to 0.95: substituted words, an appended passage, a removed passage; none may be missed."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    docs, pairs = [], []

    def shingles(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    for g in range(30):
        for n in (100, 450):
            b = [r.choice(words) for _ in range(n)]
            more = ["new" + r.choice(words) for _ in range(n)]
            few, many = set(r.sample(range(n), n // 90)), set(r.sample(range(n), n // 50))
            for near in (
                *[[more[i] if i in at else w for i, w in enumerate(b)] for at in (few, many)],
                *[b + more[: int(n * share)] for share in (0.05, 0.11, 0.24)],
                *[b[int(n * share) :] for share in (0.05, 0.1, 0.18)],
            ):
                common, union = len(shingles(b) & shingles(near)), len(shingles(b) | shingles(near))
                assert common < union
                if common >= 0.8 * union:
                    own = [f"{len(pairs)}_{w}" for w in b], [f"{len(pairs)}_{w}" for w in near]
                    pairs.append((len(docs), len(docs) + 1, common / union))
                    docs += [(len(docs) + i, " ".join(t)) for i, t in enumerate(own)]
    assert min(j for *_, j in pairs) < 0.82 and len(pairs) > 350
    got = {x.doc_id: x.component_id for x in simhash.text_groups(text_frame(spark, docs)).collect()}
    assert [(a, b, j) for a, b, j in pairs if got[a] != a or got[b] != a] == []


def test_similarity_of_a_crowd_is_held_in_strips(monkeypatch):
    import tracemalloc

    r = np.random.default_rng(6)
    base = r.integers(-(2**62), 2**62, 40)
    sets = [np.unique(np.where(r.random(40) < r.choice([0, 0.05, 0.5]), r.integers(-(2**62), 2**62, 40), base)) for _ in range(90)]
    want = [[i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for pairs in (1, 700, 6_500, simhash.PAIRS):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        assert simhash._similar(sets, 0.8).tolist() == want
    crowd = [np.sort(np.append(base[:5], i)) for i in range(4_000)]
    tracemalloc.start()
    linked = simhash._similar(crowd, 0.8)
    assert not linked.any() and simhash._forest(~linked) == [(0, i) for i in range(1, 4_000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {x.node: x.root for x in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_runs_cover_every_window_once():
    r = np.random.default_rng(0)
    units = windows.BYTE_VALUES[r.integers(0, 3, 5000)]
    stops = np.repeat([1200, 1300, 5000], [1200, 100, 3700])
    first, last, anchor, _ = windows.runs(units, stops, 200, 32)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert starts.tolist() == [i for i in range(4801) if i + 200 <= stops[i]]
    assert ((anchor >= last) & (anchor + 32 <= first + 200)).all()


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    import pyarrow as pa

    text = " ".join(np.random.default_rng(1).choice(["a", "bc", "def", "gh"], 3000).tolist())

    def windows_of(kind, window, gram):
        return sorted((s, int(a)) for _, f, la, an, h in windows.KINDS[kind](pa.array([text, None, "", text]), window, gram) for x, y, a in zip(f, la, an, strict=True) for s in range(x, y + 1))

    whole = windows_of("bytes", 200, 32), windows_of("words", 13, 4)
    monkeypatch.setattr(windows, "PIECE", 500)
    assert (windows_of("bytes", 200, 32), windows_of("words", 13, 4)) == whole
