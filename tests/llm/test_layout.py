import hashlib
import random

import numpy as np
import pytest

from driftwell.llm import mixing, sharding, warc
from driftwell.llm.feistel import permute


def test_feistel_is_a_permutation_with_an_inverse():
    for n in (1, 2, 3, 24, 1000, 4097):
        p = permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert (permute(p, n, 7, inverse=True) == np.arange(n)).all()
    mixed = permute(np.array([0, 1, 2, 0, 1]), np.array([3, 3, 3, 2, 2]), np.array([5, 5, 5, 6, 6]))
    assert sorted(mixed[:3].tolist()) == [0, 1, 2] and sorted(mixed[3:].tolist()) == [0, 1]


def test_shards(spark, tmp_path):
    rows = [(i % 90 if i % 10 else None, f"t{i % 90}", 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.assign_shards(frame, ["doc_id", "text"], 24, 3).collect()
    assert len(got) == 500
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
        shard, slot = sharding.locate(np.array([r.row_number]), 500, 24, 3)
        assert (shard[0], slot[0]) == (r.shard, r.slot)
        assert sharding.row_at(shard, slot, 500, 24, 3)[0] == r.row_number
    assert sorted(r.row_number for r in got) == list(range(500))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    again = sharding.assign_shards(frame.repartition(2), ["doc_id", "text"], 24, 3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.assign_shards(frame.limit(0), ["doc_id"]).count() == 0
    sharding.write_shards(sharding.assign_shards(frame, ["doc_id", "text"], 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 500


def _targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Reshares the excess of full sources until none is above its limit."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full, total = {}, share * sum(sizes)
    while True:
        rest = total - sum(full.values())
        weight = sum(w[i] for i in range(len(sizes)) if i not in full)
        over = [i for i in range(len(sizes)) if i not in full and rest * w[i] / weight >= cap * sizes[i]]
        if not over:
            return [full.get(i, rest * w[i] / weight if weight else 0.0) for i in range(len(sizes))]
        full |= {i: cap * sizes[i] for i in over}


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 900)), f"s{i % 7}" if i % 11 else None, 5) for i in range(300)]
    rows += [(900, None, "s1", 5), (901, "", "zz", 5), (902, "one two", None, 5), (None, "a b c", "s2", 5), (3, rows[3][1], "s3", 5), (3, rows[3][1], "s3", 5), (999, "x " * 30_000, "s0", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    laid, pieces, placement = mixing.mix(frame, block_words=64, shard_slots=128)
    got = mixing.words_taken(laid, pieces, placement).collect()
    assert sorted(x.size for x in got) == sorted(len((t or "").split()) for _, t, *_ in rows)
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s, _ in rows if s == n) for n in names]
    for sid, (size, target) in enumerate(zip(sizes, _targets(sizes), strict=True)):
        mine = [x for x in got if x.sid == sid]
        assert {x.source_size for x in mine} == {size}
        assert all(abs(x.target - target) < 1e-6 * max(1, target) for x in mine)
        assert abs(sum(x.taken for x in mine) - target) <= 2 * 64 + 0.01 * target
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    again = mixing.mix(frame.repartition(2), block_words=64, shard_slots=128)
    assert sorted(map(str, got)) == sorted(map(str, mixing.words_taken(*again).collect()))
    texts = mixing.mixed_documents(frame.selectExpr("doc_id", "text", "'xx' lang", "source", "1L n_chars"), laid, pieces, placement)
    assert sum(len(x.text.split()) for x in texts.collect()) == sum(x.taken for x in got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.words_taken(*mixing.mix(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [x.taken for x in mixing.words_taken(*mixing.mix(blank)).collect()] == [0, 0]


def _fake(n: int) -> str:
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {n}\r\n\r\n"


@pytest.mark.parametrize("block", ["128m", "20k"])
def test_warc_round_trip(spark, tmp_path, block):
    r = random.Random(4)
    pages = []
    for i in range(150):
        t = "".join(r.choice("abc é\r\n<>") for _ in range(r.randint(0, 3000)))
        if i % 5 == 0:
            t = t[:100] + _fake(r.choice([5, 20, 200, 10**9])) + "x" * 20 + "\r\n\r\n" + t[100:]
        if i % 7 == 0:
            t += "WARC/1.1\r\n" * r.randint(1, 40)
        if i % 11 == 0:
            t = t + _fake(40) + "y" * 40 + "\r\n\r\n" + _fake(3) + "zzz\r\n\r\n" + t
        pages.append((i, f"http://h/{i}", t))
    pages += [(1000 + i, None, pages[i % 4][2]) for i in range(40)]
    pages += [(None, "u\r\nX: y", None), (None, "u", pages[5][2]), (5000, "", ""), (5001, None, "a" * 1000), (5002, None, "a" * 1000), (5003, None, "a" * 999), (5004, None, "a" * 999)]
    pages += [(7000, "q", _fake(0) * 700), (7001, "q", "k" * 50_000 + _fake(10) + "m" * 9000)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(2)
    kept: dict[bytes, list] = {}
    for i, _, h in pages:
        kept.setdefault((h or "").encode(), []).append(i)
    want = []
    for i, _, h in pages:
        h = (h or "").encode()
        known = [x for x in kept[h] if x is not None]
        to = max(known) if len(h) >= 1000 and known else None
        revisit = to is not None and i != to
        want.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        warc.write_archives(frame, str(tmp_path / "a"))
        rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0
