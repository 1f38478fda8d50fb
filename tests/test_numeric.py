import datetime as dt
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import numeric as nm
from driftwell.operators import baseline as bl
from driftwell.operators import daily as dy
from driftwell.operators import orderstats as osx


def test_round4_half_away_and_no_negative_zero(spark):
    rows = spark.createDataFrame([(2.00005,), (-2.00015,), (-0.00001,), (None,)], "x double")
    got = [r[0] for r in rows.select(nm.round4(F.col("x"))).collect()]
    assert got[0] == 2.0001 and got[1] == -2.0002 and got[3] is None
    assert str(got[2]) == "0.0"


def test_finite_drops_nan_and_infinities(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.5,)], "x double")
    assert [r[0] for r in rows.select(nm.finite(F.col("x"))).collect()] == [None, None, None, 1.5]


@pytest.mark.parametrize(
    "values, median, iqr",
    [
        ([5.0], 5.0, 0.0),
        ([1.0, 4.0], 2.5, 3.0),
        ([1.0, 2.0, 3.0], 2.0, 2.0),  # halves exclude the middle: medians 1 and 3
        ([1.0, 2.0, 3.0, 4.0], 2.5, 2.0),
        ([1.0, 2.0, 3.0, 4.0, 100.0], 3.0, 50.5),
    ],
)
def test_median_and_hinge_iqr(spark, values, median, iqr):
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    row = dy.day_statistics(df, ["g"]).first()
    assert (row["median"], row["iqr"], row["n"]) == (median, iqr, len(values))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3000, 3000), min_size=1, max_size=40))
def test_order_statistics_equal_brute_force(spark, ints):
    values = [i / 100 for i in ints]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    row = osx.ranked(osx.value_counts(df, ["g"], F.col("value")), ["g"]).groupBy("g").agg(osx.median_expr().alias("m")).first()
    assert abs(row["m"] - statistics.median(values)) < 1e-9


def test_global_median_with_blocks(spark):
    for values in ([3.0, 1.0, 2.0], [1.0, 2.0, 30.0, 40.0], [7.0]):
        df = spark.createDataFrame([(v,) for v in values], "value double")
        assert osx.global_median(df, F.col("value")).first()["median"] == statistics.median(values)


def test_large_and_small_values_are_neither_cut_nor_saturated(spark):
    rows = spark.createDataFrame([(1e15,), (-3e17,), (1e-7,)], "x double")
    assert [r[0] for r in rows.select(nm.round4(F.col("x"))).collect()] == [1e15, -3e17, 0.0]
    big = spark.createDataFrame([(1, "d", v) for v in (1e13, 2e13, 3e13)], "participant_id long, date string, value double")
    assert dy.daily_medians(big, ["participant_id", "date"], ["value"]).first()["value"] == 2e13
    assert dy.day_statistics(big.withColumnRenamed("date", "g"), ["g"]).first()["mean"] == 2e13
    small = spark.createDataFrame([(v,) for v in (1.1e-7, 2.2e-7, 3.3e-7)], "value double")
    labels = dy.binarize_at_median(small, small, "value").orderBy("value").collect()
    assert [r["label"] for r in labels] == [0, 0, 1]


def test_global_median_of_many_values(spark):
    df = spark.range(20_001).select((F.exp(F.col("id") / 1000) - 5).alias("value"))
    want = df.orderBy("value").collect()[10_000]["value"]
    assert osx.global_median(df, F.col("value")).first()["median"] == want


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9, 0.7] * 50
    for seed in (1, 2):
        df = spark.createDataFrame([(v,) for v in values], "v double").orderBy(F.rand(seed)).repartition(5)
        assert df.agg(nm.exact_sum(F.col("v"))).first()[0] == 65.0
    wide = spark.createDataFrame([(1e200,), (2e200,)], "v double")
    assert wide.agg(nm.exact_sum(F.col("v"))).first()[0] == 3e200


def test_one_hot_group_is_combined_before_the_ranking(spark):
    """A group with most rows but few distinct values reaches the window as its distinct values only."""
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") % 50 / 10).alias("value"))
    counts = osx.value_counts(df, ["g"], F.col("value"))
    assert counts.count() == 50
    assert counts.agg(F.sum("c")).first()[0] == 200_000


def _hub(spark, values, quality=1.0):
    day = dt.date(2024, 1, 1)
    rows = [(1, "motor", "cadence", day + dt.timedelta(i), v, quality) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "participant_id long, modality string, feature_name string, date date, value double, quality_score double")


def test_baseline_statistics_by_hand(spark):
    row = bl.baseline_row(_hub(spark, [10.0, 12.0, 14.0, 16.0])).first()
    assert row["baseline_mean"] == 13.0 and row["baseline_median"] == 13.0
    assert row["baseline_std"] == 2.582 and row["baseline_mad"] == 2.0
    assert (row["q1"], row["q3"], row["iqr"]) == (11.5, 14.5, 3.0)
    assert row["coefficient_of_variation"] == 0.1986
    assert (row["lower_bound"], row["upper_bound"]) == (7.0, 19.0)


@pytest.mark.parametrize("days, status", [(13, "calibrating"), (14, "established")])
def test_fourteen_days_establish(spark, days, status):
    assert bl.baseline_row(_hub(spark, [float(i) for i in range(days)])).first()["baseline_status"] == status


def test_single_value_and_constant_series(spark):
    row = bl.baseline_row(_hub(spark, [5.0])).first()
    assert row["baseline_std"] == 0.0 and row["baseline_mad"] == 0.0
    assert (row["lower_bound"], row["upper_bound"]) == (4.997, 5.003)


def test_three_mad_exactly_is_no_outlier(spark):
    base = bl.baseline_row(_hub(spark, [10.0, 12.0, 14.0, 16.0]))
    got = {r["value"]: r["is_outlier"] for r in bl.detect_outliers(_hub(spark, [19.0, 19.01]), base).collect()}
    assert got == {19.0: False, 19.01: True}


def test_adaptive_baseline_equals_a_plain_loop(spark):
    base = bl.baseline_row(_hub(spark, [10.0, 12.0, 14.0, 16.0]))
    values = [13.5, 60.0, 12.2, 15.9, 11.1]
    got = bl.adaptive_baseline(_hub(spark, values), base).first()
    r = lambda x: round(x + 0.0, 4)
    mean, median, std, mad, n, out = 13.0, 13.0, 2.582, 2.0, 4, 0
    for v in values:
        if r(abs(v - median) / (mad or std * 0.6745 or 0.001)) > 3:
            out += 1
            continue
        mean, median = r(0.1 * v + 0.9 * mean), r(0.1 * v + 0.9 * median)
        std = r((0.1 * (v - mean) ** 2 + 0.9 * std**2) ** 0.5)
        mad, n = r(0.1 * abs(v - median) + 0.9 * mad), n + 1
    assert out == 1 and got["rejected_outlier"] == 1 and got["sample_count"] == n
    assert (got["baseline_mean"], got["baseline_median"], got["baseline_std"], got["baseline_mad"]) == pytest.approx((mean, median, std, mad), abs=1e-4)
    assert got["baseline_version"] == "1.0.4"


def test_low_quality_day_leaves_the_baseline(spark):
    base = bl.baseline_row(_hub(spark, [10.0, 12.0, 14.0, 16.0]))
    got = bl.adaptive_baseline(_hub(spark, [13.0], quality=0.49), base).first()
    assert got["rejected_low_quality"] == 1 and got["baseline_version"] == "1.0.0"


def test_version_bump(spark):
    df = spark.createDataFrame([("1.2.3",), (None,), ("x",), ("2",)], "v string")
    assert [r[0] for r in df.select(bl.bump_patch(F.col("v"))).collect()] == ["1.2.4", "1.0.1", "1.0.1", "2.0.1"]


def test_a_series_without_new_days_keeps_its_baseline(spark):
    base = bl.baseline_row(_hub(spark, [10.0 + i % 3 for i in range(14)]))
    none = _hub(spark, [11.0]).limit(0)
    got = bl.adaptive_baseline(none, base).first()
    want = base.first()
    assert (got["baseline_mean"], got["baseline_median"], got["sample_count"], got["baseline_version"]) == (want["baseline_mean"], want["baseline_median"], 14, "1.0.0")
