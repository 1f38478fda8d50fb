import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.operators import daily as dy
from driftwell.operators import quality as dq
from driftwell.operators import trend as tr
from driftwell.sources import sinks as sk

HUB = "participant_id long, modality string, feature_name string, date date, value double, quality_score double"


def _day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(i)


def _sessions(spark, rows):
    return spark.createDataFrame(rows, "participant_id long, date date, modality string, quality_score double, typing_speed double, cadence double")


def test_quality_exactly_at_the_threshold_passes(spark):
    s = _sessions(spark, [(1, _day(0), "typing", 0.50, 4.0, None), (1, _day(0), "typing", 0.4999, 5.0, None), (1, _day(0), "typing", None, 5.0, None)])
    rows = dy.quality_gate(s).orderBy("typing_speed", F.desc_nulls_last("quality_score")).collect()
    assert [r["accepted"] for r in rows] == [True, False, False]
    assert rows[1]["rejection_reason"] == "Quality score 0.500 is below minimum threshold 0.5"


def test_percent_score_and_signal_quality_fallbacks(spark):
    df = spark.createDataFrame([(None, 80.0, None), (None, 0.7, None), (None, None, 0.6), (1.4, 10.0, 0.1), (None, None, None)], "quality_score double, score double, signal_quality double")
    assert [r[0] for r in df.select(dy.session_quality(df)).collect()] == [0.8, 0.7, 0.6, 1.0, 0.0]


def test_day_keeps_missing_modalities_null(spark):
    s = _sessions(spark, [(1, _day(0), "typing", 0.9, 4.0, None), (1, _day(0), "typing", 0.8, 5.0, None), (1, _day(0), "motor", 0.2, None, 100.0)])
    v = dy.daily_vector(s)
    row = v.first()
    assert row["typing"]["typing_speed"] == 4.5 and row["motor"] is None and row["voice"] is None
    assert row["available_modalities"] == ["typing"]
    assert row["missing_modalities"] == ["voice", "motor", "visual", "sleep"]
    assert row["low_quality_modalities"] == ["motor"]
    assert row["quality"]["overall_quality"] == pytest.approx((0.85 + 0.2) / 2)
    assert dq.audit_no_imputation(v).first()["errors"] == []


def test_two_far_apart_sessions_disagree(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.8), ("h", 1.0), ("h", 1.05)], "feature_name string, value double")
    got = {r["feature_name"]: r["disagree"] for r in dy.disagreement(dy.day_statistics(df, ["feature_name"])).collect()}
    assert got == {"g": True, "h": False}


def test_modal_label_and_median_binarisation(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("a", 8.0, "y"), ("b", 2.0, "z")], "p string, v double, l string")
    out = {r["p"]: (r["v"], r["l"]) for r in dy.participant_rollup(df, "p", ["v"], "l", "median").collect()}
    assert out == {"a": (3.0, "y"), "b": (2.0, "z")}
    assert sorted(r["label"] for r in dy.binarize_at_median(df, df, "v").collect()) == [0, 0, 1, 1]


def _series(spark, values, z=None):
    rows = [(1, "motor", "cadence", _day(i), v, 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, HUB)


def _base(spark, mean, std, median, mad):
    return spark.createDataFrame([(1, "motor", "cadence", mean, median, std, mad)], "participant_id long, modality string, feature_name string, baseline_mean double, baseline_median double, baseline_std double, baseline_mad double")


@pytest.mark.parametrize(
    "base, value, z, method",
    [
        ((10.0, 2.0, 10.0, 1.0), 13.0, 1.5, "parametric_std"),
        ((10.0, 0.0, 10.0, 2.0), 14.0, 1.349, "mad_fallback"),
        ((10.0, 0.0, 10.0, 0.0), 10.0, 0.0, "zero_dispersion"),
        ((10.0, 0.0, 10.0, 0.0), 9.0, -10.0, "zero_dispersion_extreme"),
        ((10.0, 2.0, 10.0, 1.0), None, None, "invalid_value"),
    ],
)
def test_deviation_ladder(spark, base, value, z, method):
    row = tr.deviation(_series(spark, [value]), _base(spark, *base)).first()
    assert (row["z_score"], row["method"]) == (z, method)


def test_absent_baseline(spark):
    row = tr.deviation(_series(spark, [1.0]), _base(spark, 1.0, 1.0, 1.0, 1.0).where("false")).first()
    assert row["method"] == "missing_baseline" and row["z_score"] is None


@pytest.mark.parametrize("z, streak, label, level", [(1.49, 0, fv.LABEL_WITHIN, 0), (1.5, 0, fv.LABEL_MILD, 1), (2.0, 9, fv.LABEL_MODERATE, 2), (-3.0, 4, fv.LABEL_SIGNIFICANT, 3), (2.1, 5, fv.LABEL_SUSTAINED, 4), (None, 9, fv.LABEL_WITHIN, 0)])
def test_bands(spark, z, streak, label, level):
    df = spark.createDataFrame([(z, streak)], "z_score double, streak int")
    row = tr.classify(df, "streak").first()
    assert (row["label"], row["severity"]) == (label, level)


def _dev(spark, zs):
    return spark.createDataFrame([(1, "motor", "cadence", _day(i), z) for i, z in enumerate(zs)], "participant_id long, modality string, feature_name string, date date, z_score double")


@pytest.mark.parametrize(
    "zs, current, runs, longest",
    [
        ([3.0] * 4, 4, 0, 4),
        ([3.0] * 5, 5, 1, 5),
        ([3.0] * 5 + [1.0, -2.5], 1, 1, 5),
        ([3.0, 3.0, None, 3.0, 3.0], 2, 0, 2),
        ([2.0] * 6, 0, 0, 0),
    ],
)
def test_streaks(spark, zs, current, runs, longest):
    dev = _dev(spark, zs)
    assert tr.current_streak(dev).first()["consecutive_days"] == current
    assert tr.sustained_runs(dev).count() == runs
    assert tr.max_streak(dev).first()["max_streak"] == longest


def test_trend_row(spark):
    values = [10.0, 11.0, None, 13.0, 14.0, 15.0, 16.0, 17.0]
    rows = tr.longitudinal(_series(spark, values), _base(spark, 10.0, 2.0, 10.0, 1.0)).orderBy("date").collect()
    last = rows[-1]
    assert last["fourteen_day_trend"] == 1.0  # the null keeps its position
    assert last["seven_day_average"] == round((11 + 13 + 14 + 15 + 16 + 17) / 6, 4)
    assert last["missingness"] == 0.5 and last["sustained_deviation"] == 3
    assert last["trend_label"] == fv.TREND_PROGRESSIVE
    assert rows[0]["fourteen_day_trend"] == 0.0 and rows[0]["seven_day_variability"] == 0.0


def test_trend_windows_share_one_sort(spark):
    plan = tr.longitudinal(_series(spark, [1.0, 2.0]), _base(spark, 1.0, 1.0, 1.0, 1.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [participant_id") <= 3  # join sides and one window stage
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_concern_counts_distinct_days(spark):
    t = dt.datetime(2024, 1, 10, 22)
    rows = [(1, t, True), (1, t + dt.timedelta(minutes=5), True), (1, t + dt.timedelta(days=1), False), (2, t, True), (2, t + dt.timedelta(days=2), True), (2, t - dt.timedelta(days=30), True)]
    df = spark.createDataFrame(rows, "participant_id long, timestamp timestamp, unusual_movement_self_report boolean")
    got = {r["participant_id"]: (r["positive_days"], r["flagged"]) for r in tr.concern_window(df, "2024-01-13 00:00:00").collect()}
    assert got == {1: (1, False), 2: (2, True)}


def test_day_names_each_disagreement_and_keeps_iqrs(spark):
    """The records name feature and reason; the counts of old stay as they are."""
    rows = [(1, _day(0), "typing", 0.9, 4.0, None), (1, _day(0), "typing", 0.8, 9.0, None), (1, _day(0), "motor", 0.9, None, 100.0), (1, _day(0), "motor", 0.9, None, 101.0)]
    row = dy.daily_vector(_sessions(spark, [*rows, (2, _day(0), "motor", 0.1, None, 9.0)])).where("participant_id = 1").first()
    assert row["disagreement_count"] == 1
    (found,) = row["disagreements"]
    assert (found["modality"], found["feature"], found["session_count"], found["iqr"]) == ("typing", "typing_speed", 2, 5.0)
    assert found["reason"] == "Significant session disagreement in typing_speed: CV=0.54, relative IQR=0.77"
    assert (row["iqr"]["typing"]["typing_speed"], row["iqr"]["motor"]["cadence"], row["iqr"]["voice"]) == (5.0, 1.0, None)
    poor = dy.daily_vector(_sessions(spark, [(2, _day(0), "motor", 0.1, None, 9.0)])).first()
    assert (poor["disagreements"], poor["disagreement_count"]) == ([], 0)
    stored = sk.daily_record(dy.daily_vector(_sessions(spark, rows))).first()["data_quality"]
    assert [d["feature"] for d in stored["disagreements"]] == ["typing_speed"] and stored["iqr"]["typing"]["typing_speed"] == 5.0
