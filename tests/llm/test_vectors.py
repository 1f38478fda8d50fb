import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import collisions, forest

SCHEMA = "vec_id long, embedding array<float>, copies int, node string"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    base = r.standard_normal((400, 64))
    near = base[r.integers(0, 400, 200)] + 0.25 * r.standard_normal((200, 64))
    vectors = np.concatenate([base, near, base[:30], np.repeat(base[50:51], 20, 0)]).astype(np.float32)
    out = [(i, [float(x) for x in v], 1, "n") for i, v in enumerate(vectors)]
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3, []]
    out += [(1000 + 50 * i, v, 1, "n") for i, v in enumerate(bad)]
    return [*out, (None, out[0][1], 1, "n"), out[50], out[51]]


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]


def test_nearest(spark, rows):
    got = forest.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, 5).collect()
    pool = dict(usable(rows))
    ids = np.array(sorted(pool))
    points = np.array([pool[i] / np.linalg.norm(pool[i]) for i in ids])
    found = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    hits = 0
    for q in ids[ids % 50 == 0].tolist():
        scores = points @ points[np.searchsorted(ids, q)]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if ids[i] != q][:5]
        assert [x[0] for x in found[q]] == [1, 2, 3, 4, 5]
        assert all(abs(scores[np.searchsorted(ids, v)] - s) < 1e-9 for _, v, s in found[q])
        hits += len({int(ids[i]) for i in order} & {x[1] for x in found[q]})
    assert set(found) == set(ids[ids % 50 == 0].tolist())
    assert hits >= 0.9 * 5 * len(found)
    # Copies come in the order of their ids, never the query itself.
    assert [x[1] for x in found[50]] == [630, 631, 632, 633, 634]


def test_near_duplicates(spark, rows):
    got = collisions.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    good = usable(rows)
    ids = np.array([i for i, _ in good])
    points = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = points @ points.T >= 0.9
    want = {}
    for n, i in enumerate(ids.tolist()):
        want[i] = int(linked[n].sum()) - 1
    links = {x.vec_id: x.n_links for x in got if x.vec_id in want}
    assert sum(links.values()) >= 0.98 * sum(want.values())
    assert all(links[i] <= want[i] for i in want)
    assert {x.component_id for x in got if x.vec_id is not None and x.vec_id >= 630 and x.vec_id < 650} == {50}
    assert all(x.n_links == 0 and x.kept and x.component_id == x.vec_id for x in got if x.vec_id is not None and x.vec_id >= 1000)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got if x.vec_id is not None)


def test_widths_are_compared_within_themselves(spark):
    r = np.random.default_rng(5)
    wide = [(i, [float(x) for x in r.standard_normal(4)], 1, "n") for i in range(60)]
    narrow = [(100 + i, [1.0, 2.0, 3.0 + i * 1e-3], 1, "n") for i in range(4)] + [(200, [1.0, 2.0, 3.0], 1, "n"), (300, [7.0], 1, "n")]
    frame = spark.createDataFrame(wide + narrow, SCHEMA).repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in collisions.near_duplicates(frame).collect()}
    assert len(got) == 66 and got[300] == (0, 300, True)
    assert {got[i] for i in (101, 102, 103, 200)} == {(4, 100, False)} and got[100] == (4, 100, True)
    points = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in wide}
    assert all(got[i][0] <= sum(points[i] @ points[j] >= 0.9 for j in points) - 1 and got[i][1] < 60 for i in points)
    near = forest.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()
    found = {q: [x.vec_id for x in sorted(near, key=lambda x: x["rank"]) if x.query_id == q] for q in (0, 50, 100, 200, 300)}
    assert found[200] == [100, 101, 102, 103] and found[100] == [200, 101, 102, 103] and found[300] == []
    assert len(found[0]) == len(found[50]) == 5 and max(found[0] + found[50]) < 60


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert forest.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    assert collisions.near_duplicates(none).count() == 0


def test_prefix_descent_finds_equal_strings():
    points = np.random.default_rng(3).standard_normal((200, 16))
    trees = forest.Forest(points, 10, 1)
    assert all(i in met for i, met in enumerate(trees.candidates(points, 1)))
