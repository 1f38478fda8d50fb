"""Quality rules, phrase collocations and the conversation trie against brute force, on tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import collocations, quality, trie
from tests.llm.helpers import awkward_texts, ordered, text_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    met = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if met[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    docs = awkward_texts()
    docs += [(200 + i, "\n".join(r.choice(["a b c d e", "x#* é", "", " ", "12 34", "a b c d e f", "Q. E|D"]) for _ in range(r.randint(0, 30)))) for i in range(40)]
    docs += [(300, "a\x85b c d e"), (301, "\n\n"), (302, "z" * 9000), (303, "p q r s t " * 3000), (304, "\r\n a\r\n a\r\n")]
    got = quality.measures(text_frame(spark, docs)).collect()
    want = [(d, *brute_measures(t)) for d, t in docs]
    assert ordered([(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got]) == ordered(want)


def test_slices_do_not_change_counts():
    texts = [t.encode() for _, t in awkward_texts() if t is not None]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = quality._measure(data, offsets)
    for i, t in enumerate(texts):
        alone = quality._measure(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert all(whole[c][i] == alone[c][0] for c in quality.COUNTS)


def test_estimate_learns_which_rules_tell_quality():
    """Against the best verdict possible, which knows how often each rule votes bad; the last rule says nothing."""
    r = random.Random(8)
    lists, truth = Counter(), []
    on_bad, on_good, share = [0.8, 0.6, 0.5, 0.03], [0.03, 0.02, 0.02, 0.03], 0.75
    for _ in range(20_000):
        good = r.random() < share
        votes = tuple(0 if r.random() < 0.1 else -1 if r.random() < p else 1 for p in (on_good if good else on_bad))
        truth.append((votes, good))
        lists[votes] += 1

    def right(prior, bad, fine):
        odds = [prior + sum(bad[j] if v == -1 else fine[j] if v else 0 for j, v in enumerate(votes)) for votes, _ in truth]
        return sum((o >= 0) == good for o, (_, good) in zip(odds, truth, strict=True)) / len(truth)

    prior, bad, fine = quality.estimate(lists, 4)
    known = [math.log(g / b) for b, g in zip(on_bad, on_good, strict=True)], [math.log((1 - g) / (1 - b)) for b, g in zip(on_bad, on_good, strict=True)]
    assert right(prior, bad, fine) > right(math.log(share / (1 - share)), *known) - 0.01
    assert abs(bad[3]) < min(map(abs, bad[:3])) and fine[3] < min(fine[:3])


def test_estimate_without_documents():
    prior, bad, good = quality.estimate({}, 5)
    assert prior == pytest.approx(math.log(quality.PRIOR_GOOD / (1 - quality.PRIOR_GOOD)))
    assert len(bad) == len(good) == 5


def test_judge_follows_its_weights_and_the_base(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    good = [(i, "\n".join(" ".join(r.choice(words) for _ in range(12)) + "." for _ in range(6))) for i in range(300)]
    junk = [(1000 + i, " ".join(r.choice("abcdefgh") + "$$$" + r.choice(["###", "&&&", "***"]) for _ in range(80))) for i in range(40)]
    odd = [(None, None), (5000, ""), (5001, "one two"), (5002, "a b c d e " * 20), (3, good[3][1])]
    rows = quality.judge(text_frame(spark, good + junk + odd)).collect()
    lists = Counter(tuple(x.votes) for x in rows)
    prior, bad, fine = quality.estimate(lists, len(quality.rules()))
    for x in rows:
        odds = prior + sum(bad[j] if v == -1 else fine[j] if v else 0 for j, v in enumerate(x.votes))
        assert x.posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)
        base = x.n_words < 10 or x.n_repeat_words * 100 > 20 * x.n_words
        assert (x.base_failed, x.kept) == (base, not base and x.posterior >= 0.5)
    kept = {x.doc_id: x.kept for x in rows}
    assert sum(kept[i] for i, _ in good) >= 297
    assert not any(kept[i] for i, _ in junk) and not any(kept[i] for i in (None, 5000, 5001, 5002))
    assert quality.judge(text_frame(spark, good).limit(0)).count() == 0


def test_kept_agrees_with_quality_labels(spark, sf):
    """The labels take no part in the estimate; rows that only the base rejects are left out."""
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = rows.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(x.kept for x in seen if x.quality == 1) >= 0.97 * sum(x.quality == 1 for x in seen)
    assert sum(not x.kept for x in seen if x.quality == 0) >= 0.8 * sum(x.quality == 0 for x in seen)


def brute_collocations(docs, longest, least, per_lang=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    many = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), a in many.items():
        for k in range(2, len(p)):
            inside |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if f[lang, p[i : i + k]] <= a}
    out = {}
    for (lang, p), a in many.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:per_lang])]


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_collocations_equal_brute_force(spark, size, monkeypatch):
    r = random.Random(4)
    vocabulary = ["New", "york", "city", "É", "é", "of", "A", "x" * 40, "日本", "\x85", "a|b"]
    docs = [(r.choice(["en", "en", "de", None, "und", ""]), "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\t", ", ", ". ", "\n", " "]) for _ in range(r.randint(0, 120)))) for _ in range(60)]
    docs += [("en", None), ("en", ""), (None, " ,.; \n"), ("fr", "tick tock " * 400), ("fr", "new york city hall " * 9), ("en", docs[0][1]), ("en", docs[0][1])]
    frame = spark.createDataFrame([(*d, 1, 2, "z") for d in docs], "lang string, text string, n int, code int, word string").repartition(3)
    real = collocations.frequent_phrases
    monkeypatch.setattr(collocations, "frequent_phrases", lambda d, k, m: real(d, k, m, size))
    found = collocations.collocations(frame, least=9)
    for limit in (2000, 3):
        got = collocations.best(found, limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert ordered(got) == ordered(brute_collocations(docs, 5, 9, limit))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.best(collocations.collocations(empty)).count() == 0
    blank = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert collocations.best(collocations.collocations(blank)).count() == 0


def test_no_row_for_each_listed_word_or_pair(spark, monkeypatch):
    """Blocks deal their words and pairs packed, so tables grow with blocks and frequent phrases, not with pairs met."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    docs = [("en", " ".join(r.choice(words) for _ in range(20_000))), ("de", "w1 w2 w3 " * 60)]
    frame, rows = spark.createDataFrame(docs, "lang string, text string").coalesce(1), {}

    def counting(write):
        def counted(df, name, *more, **options):
            written = write(df, name, *more, **options)
            rows[more[0] if more else name] = written.count()
            return written

        return counted

    monkeypatch.setattr(collocations, "shared_table", counting(collocations.shared_table))
    monkeypatch.setattr(collocations, "bucketed_table", counting(collocations.bucketed_table))
    _, found = collocations.frequent_phrases(frame, longest=3, least=50)
    assert [x.groupBy("lang").count().orderBy("lang").collect() for x in found] == [[("de", 3), ("en", 200)], [("de", 3)], [("de", 3)]]
    assert rows["words"] == 2 and max(rows.values()) <= 2 * 64 + 203


def test_pairs_past_64_bits_are_refused():
    collocations.Pairs(64, 1 << 34)
    with pytest.raises(ValueError):
        collocations.Pairs(64, 1 << 35)


def test_scores_pass_64_bits():
    a, n = 3 * 10**12, 9 * 10**13
    assert collocations.weakest_cut([4 * 10**12, a], [5 * 10**12, a], n) == (1000 * a * n // (20 * 10**24), 1, 4 * 10**12, 5 * 10**12)
    assert collocations.weakest_cut([10, 10, 10], [10, 10, 10], 100)[1] == 1


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    nodes, children, below = {}, {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for p in nodes:
        children.setdefault(p[:-1], []).extend([p] if p else [])
    out = []
    for p in sorted(nodes, key=len, reverse=True):
        mine = children.get(p, [])
        saved = (len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        below[p] = (saved + sum(below[k][0] for k in mine), (not mine) + sum(below[k][1] for k in mine))
        ends = ",".join(str(c) for c in sorted(nodes[p]) if built[c] == p)
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(mine), below[p][1], below[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(spark):
    r = random.Random(6)
    rows = []
    for c in [*range(90), -3, -20, -25, 10**12, 10**12 + 7]:
        if c % 20 == 0 and c in (40, 80):
            continue  # bases that are not there
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "bot", None, ""]), r.choice(["hi", "a b", "", None, "x\ty z", f"t{t}"])))
        rows = [x for i, x in enumerate(rows) if (x[0], x[1]) not in {(y[0], y[1]) for y in rows[:i]}]
    rows += [(500 + i, t, "user", f"turn {t % 3}") for i in range(3) for t in range(700 if i == 0 else 5)]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(700, 3, "user", "twice"), (700, 3, "user", "twice")]
    frame = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "conv_id long, turn long, role string, text string, depth int, a int, part int")
    return frame.repartition(5), rows


def test_trie_equals_brute_force(spark):
    frame, rows = conversations(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert ordered(trie.prefix_trie(frame).drop("a", "b").collect()) == ordered(brute_trie(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_colliding_fingerprints_are_found_and_another_seed_is_drawn(spark, monkeypatch):
    frame, rows = conversations(spark)
    real, seeds = trie.scanned_turns, []

    def weak(conversations, seed):
        seeds.append(seed)
        turns = real(conversations, seed)
        return turns if seed > 2 else turns.withColumns({c: F.lit(1).cast("long") for c in ("a", "ta")} | {c: F.lit(0).cast("long") for c in ("b", "tb")})

    monkeypatch.setattr(trie, "scanned_turns", weak)
    assert ordered(trie.prefix_trie(frame).drop("a", "b").collect()) == ordered(brute_trie(rows))
    assert seeds == [1, 2, 3]
    with pytest.raises(RuntimeError):
        trie.prefix_trie(frame, tries=2)


def test_maps_form_a_group():
    r = np.random.default_rng(1)
    a, b, c, d = (r.integers(0, 1 << 63, 50).astype(np.uint64) for _ in range(4))
    a, c = a | np.uint64(1), c | np.uint64(1)
    x, y = trie.product((a, b), (c, d))
    back = trie.product((x, y), trie.inverse(c, d))
    assert (back[0] == a).all() and (back[1] == b).all()
    one = trie.product((int(a[0]), int(b[0])), (int(c[0]), int(d[0])))
    assert one == (int(x[0]), int(y[0]))
    assert trie.product((int(a[0]), int(b[0])), trie.inverse(int(a[0]), int(b[0]))) == trie.ONE


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(nobody).count() == 0
