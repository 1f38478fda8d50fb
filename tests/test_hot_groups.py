"""Groups too large for one task are cut at their own quantiles; results equal those of one window."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from driftwell.operators import daily as dy
from driftwell.operators import evaluation as ev
from driftwell.operators import orderstats as osx


def _values():
    """A group of 20,000 distinct values within a thousandth, one with many ties, small ones and one without a name."""
    r = random.Random(7)
    close = [0.5 + i * 5e-8 for i in range(20_000)]
    tied = [float(r.randint(0, 900)) for _ in range(6000)]
    rows = [("close", v) for v in close] + [("tied", v) for v in tied] + [(None, v * 3) for v in close[:3000]]
    rows += [(f"g{i % 50}", r.random()) for i in range(400)] + [("close", None), ("tied", float("nan"))]
    r.shuffle(rows)
    return rows


def _brute(rows):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in groups.items()}


def test_running_counts_of_hot_groups_equal_those_of_one_window(spark):
    rows = _values()
    groups = _brute(rows)
    counts = osx.value_counts(spark.createDataFrame(rows, "g string, value double"), ["g"], F.col("value"))
    got = osx.ranked(counts, ["g"], hot=500).collect()
    assert len(got) == sum(len(set(v)) for v in groups.values())
    for r in got:
        values = groups[r["g"]]
        assert (r["cum"], r["n"]) == (bisect_right(values, r["v"]), len(values))
        assert r["sum"] == pytest.approx(sum(values))


def test_a_hot_group_is_ranked_by_many_tasks(spark):
    rows = [(g, v) for g, v in _values() if g == "close"]
    counts = osx.value_counts(spark.createDataFrame(rows, "g string, value double"), ["g"], F.col("value"))
    sizes = [r["count"] for r in osx.in_blocks(counts, ["g"], "v", hot=500).groupBy("block").count().collect()]
    assert len(sizes) > osx.BLOCKS * 0.9 and max(sizes) < 3 * 20_000 / osx.BLOCKS
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        ranked = osx.ranked(counts, ["g"], hot=500)
        per_task = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) == 16 and max(per_task) < 20_000 / 5
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line and "cum" not in line and "block" not in line]
        assert not [line for line in windows if "v#" in line.split("],")[-1]], "no window orders values of a whole group"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_day_statistics_do_not_depend_on_the_cut(spark, monkeypatch):
    rows = [(g, v) for g, v in _values() if g is not None]
    frame = spark.createDataFrame(rows, "g string, value double")
    columns = ["g", "n", "median", "iqr", "min_value", "max_value"]
    plain = sorted(map(tuple, dy.day_statistics(frame, ["g"]).select(*columns).collect()))
    real = osx.ranked
    monkeypatch.setattr(osx, "ranked", lambda counts, keys: real(counts, keys, hot=300))
    cut = dy.day_statistics(frame, ["g"])
    assert sorted(map(tuple, cut.select(*columns).collect())) == plain


def test_score_curves_of_close_scores(spark):
    r = random.Random(9)
    scores = [(0.4 + r.random() * 1e-3, int(r.random() < 0.4), "ab"[i % 2]) for i in range(30_000)] + [(None, 1, "a"), (0.4, None, "b")]
    frame = spark.createDataFrame(scores, "score double, label int, part string")
    known = [(s, y) for s, y, _ in scores if s is not None]
    positive, negative = (sorted(s for s, y in known if y == k) for k in (1, 0))
    got = ev.score_counts(frame, "label", "score", [], hot=1000).collect()
    assert len(got) == len({s for s, _ in known})
    for x in got:
        assert (x["pos_below"], x["neg_below"]) == (bisect_left(positive, x["s"]), bisect_left(negative, x["s"]))
    per = frame.where("score is not null").groupBy(F.col("score").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    sizes = [x["count"] for x in osx.in_blocks(per, [], "s", hot=1000).groupBy("block").count().collect()]
    assert len(sizes) > osx.BLOCKS * 0.9 and max(sizes) < 3 * 30_000 / osx.BLOCKS
    by = {(x["part"], x["s"]): x["neg_below"] for x in ev.score_counts(frame, "label", "score", ["part"], hot=1000).collect()}
    for part in "ab":
        mine = sorted(s for s, y, p in scores if p == part and y == 0 and s is not None)
        assert all(n == bisect_left(mine, s) for (p, s), n in by.items() if p == part)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, value double")
    assert osx.ranked(osx.value_counts(empty, ["g"], F.col("value")), ["g"]).count() == 0
    assert ev.score_counts(spark.createDataFrame([], "score double, label int"), "label", "score", []).count() == 0
