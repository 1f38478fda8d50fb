"""The bucketed store of series, whole days of baselines, and the modality report."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from driftwell.operators import baseline as bl
from driftwell.operators import daily as dy
from driftwell.operators import trend as tr
from driftwell.plans import tables as tb
from driftwell.sources.series_store import stored_series

HUB = "participant_id long, modality string, feature_name string, date date, value double, quality_score double"


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _days(values, participant=1, start=dt.date(2024, 1, 1), quality=1.0):
    return [(participant, "motor", "cadence", start + dt.timedelta(days=i), v, quality) for i, v in enumerate(values)]


def test_readers_of_the_store_need_no_exchange(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hub, base = tb.calibrated(spark, sf, overall=False)
        for df in (bl.detect_outliers(hub, base), tr.deviation(hub, base), bl.adaptive_baseline(hub.where("date > '2024-01-20'"), base)):
            plan = _plan(df)
            assert "Exchange" not in plan
            assert len(re.findall("FileScan", plan)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_keeps_rows_and_leaves_no_catalog_entry(spark):
    rows = [*_days([1.0, 2.0]), *_days([1.0, 2.0]), (None, None, None, None, float("nan"), None)]
    hub = spark.createDataFrame(rows, HUB).withColumn("n", F.lit(7))
    tables = {t.name for t in spark.catalog.listTables()}
    store = stored_series(hub, bl.SERIES)
    assert sorted(map(repr, store.collect())) == sorted(map(repr, hub.collect()))
    assert {t.name for t in spark.catalog.listTables()} == tables
    empty = stored_series(hub.limit(0), bl.SERIES)
    assert empty.count() == 0 and empty.columns == hub.columns


@pytest.fixture(scope="module")
def day(spark):
    """Three series with the same baseline: one day accepted, one outlying, one of poor quality; a fourth has no baseline."""
    values = [10.0, 11.0, 12.0, 13.0, 14.0] * 3
    history = [r for p in (1, 2, 3) for r in _days(values, p)]
    base = bl.baseline_row(spark.createDataFrame(history, HUB))
    new = dt.date(2024, 2, 1)
    rows = [(1, "motor", "cadence", new, 13.0, None), (2, "motor", "cadence", new, 40.0, 0.9), (3, "motor", "cadence", new, 12.0, 0.4), (4, "motor", "cadence", new, 1.0, 1.0)]
    rows.append((5, "motor", "cadence", new, float("nan"), 1.0))
    obs = spark.createDataFrame(rows, HUB).withColumn("q1", F.lit(-1.0))  # a name that clashes with the baseline's
    return bl.process_day(obs, base), {r["participant_id"]: r for r in base.collect()}


def test_day_moves_keeps_and_skips(day):
    processed, base = day
    got = {r["participant_id"]: r for r in processed.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "updated", 2: "rejected_outlier", 3: "rejected_low_quality"}
    assert got[1]["reason"] == "Baseline updated using EWMA (alpha = 0.1) with new observation"
    assert got[2]["reason"] == "Observation deviates by 28.0000 MAD (> 3 threshold) from personal baseline"
    assert got[3]["reason"] == "Quality score 0.40 is below minimum threshold 0.50"


def test_updated_rows_are_whole(day):
    processed, base = day
    got = {r["participant_id"]: r for r in bl.updated_baselines(processed).collect()}
    moved, old = got[1], base[1]
    # mean and median 12 move a tenth of the way to 13; MAD 1 to 0.1 * 0.9 + 0.9 * 1.
    assert (moved["baseline_mean"], moved["baseline_median"], moved["baseline_mad"]) == (12.1, 12.1, 0.99)
    assert (moved["q1"], moved["q3"]) == (11.4322, 12.7678)
    assert (moved["lower_bound"], moved["upper_bound"]) == (9.13, 15.07)
    assert (moved["baseline_status"], moved["baseline_version"], moved["sample_count"]) == ("adaptive_updated", "1.0.1", 16)
    assert moved["coefficient_of_variation"] == pytest.approx(moved["baseline_std"] / 12.1, abs=5e-5)
    assert moved["iqr"] == old["iqr"] and moved["baseline_updated_at"] == dt.date(2024, 2, 1)
    for p in (2, 3):
        kept = got[p].asDict()
        assert kept.pop("baseline_updated_at") is None
        assert kept == {c: base[p][c] for c in kept}


def test_day_deviations_leave_out_poor_quality(day):
    got = {r["participant_id"]: r for r in bl.day_deviations(day[0]).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["trend_score"], got[1]["quality_score"], got[1]["is_outlier"]) == (1.0, 1.0, False)
    assert (got[2]["mad_distance"], got[2]["anomaly_flag"]) == (28.0, "anomalous observation")


def test_modality_report_names_missing_modalities_and_reasons(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, "typing", d, 0.9), (1, "typing", d, 0.1), (1, "voice", d, 0.25), (1, "voice", d, 0.25), (1, "voice", d, None), (1, "gait lab", d, 0.8)]
    sessions = spark.createDataFrame(rows, "participant_id long, modality string, date date, quality_score double")
    got = {r["modality"]: r for r in dy.modality_report(sessions).collect()}
    assert {m: r["status"] for m, r in got.items()} == {"typing": "valid", "voice": "low_quality", "gait lab": "valid", "motor": "missing", "visual": "missing", "sleep": "missing"}
    assert got["typing"]["reasons"] == [] and (got["typing"]["passed_count"], got["typing"]["rejected_count"]) == (1, 1)
    text = "Quality score {} is below minimum threshold 0.5"
    assert [tuple(r) for r in got["voice"]["reasons"]] == [(text.format("0.000"), 1), (text.format("0.250"), 2)]
    assert (got["motor"]["quality_score"], got["motor"]["total_count"], [tuple(r) for r in got["motor"]["reasons"]]) == (None, 0, [(dy.NO_SESSIONS, 0)])
    assert dy.modality_report(sessions.limit(0)).count() == 0


def test_reasons_of_a_hot_day_stay_bounded(spark):
    sessions = spark.range(200_000).selectExpr("1L as participant_id", "'voice' as modality", "date'2024-01-01' as date", "(id % 50000) / 100000.0D as quality_score")
    voice = dy.modality_report(sessions).where("modality = 'voice'").first()
    assert len(voice["reasons"]) <= 501
    assert sum(r["sessions"] for r in voice["reasons"]) == voice["total_count"] == 200_000
