import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftwell.operators import baseline as bl
from driftwell.operators import daily as dy
from driftwell.operators import trend as tr
from driftwell.plans import tables as tb
from driftwell.sources import readers as rd
from driftwell.sources import sinks as sk
from driftwell.streaming import jobs


def test_formats_by_extension_and_typed_errors(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1.5)], "participant_id string, v double")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert rd.read_table(spark, str(tmp_path / "t.csv"), "participant_id string, v double").first()["v"] == 1.5
    assert rd.read_table(spark, str(tmp_path / "t.parquet")).first()["v"] == 1.5
    with pytest.raises(rd.DatasetNotFound):
        rd.read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        rd.read_table(spark, str(tmp_path / "t.xlsx"))


def test_folder_prefers_parquet_and_reads_every_file(spark, tmp_path):
    both, only = tmp_path / "both", tmp_path / "only"
    for i in range(2):
        spark.createDataFrame([(i,)], "v int").write.parquet(str(both / f"{i}.parquet"))
        (only).mkdir(exist_ok=True)
        (only / f"{i}.csv").write_text(f"v\n{i}\n")
    (both / "x.csv").write_text("v\n9\n")
    assert sorted(r["v"] for r in rd.read_dataset(spark, str(both)).collect()) == [0, 1]
    assert sorted(r["v"] for r in rd.read_dataset(spark, str(only), "v int").collect()) == [0, 1]
    with pytest.raises(rd.DatasetNotFound):
        rd.read_dataset(spark, str(tmp_path / "nothing"))


def test_sensor_logs(spark, tmp_path):
    line = lambda t: "\t".join([str(t)] + ["1.0"] * 8 + ["2.0"] * 8 + ["8.0", "16.0"])
    (tmp_path / "GaPt03_02.txt").write_text("\n".join(line(t / 10) for t in range(0, 121)) + "\nbroken line here\n")
    (tmp_path / "JuCo11_01.txt").write_text("\n".join(line(t / 10) for t in range(0, 50)))
    df = rd.read_sensor_logs(spark, str(tmp_path / "*.txt"))
    row = df.first()
    assert df.count() == 121
    assert (row["study"], row["study_group"], row["participant_id"], row["trial"]) == ("Ga", "patient", "GaPt03", 2)
    bad = spark.createDataFrame([("0.5 x " + "1.0 " * 15 + "8.0 9.0",), ("nan " + "1 " * 18,), ("1.0",)], "value string")
    rows = rd.parse_sensor_lines(bad).collect()
    assert len(rows) == 1 and rows[0]["l1"] is None and rows[0]["l2"] == 1.0


def test_daily_features_replace_only_their_dates(spark, tmp_path, sf):
    v = dy.daily_vector(tb.feature_sessions(spark, sf))
    path = str(tmp_path / "daily")
    sk.write_daily_features(v, path)
    n = spark.read.parquet(path).count()
    assert n == v.count()
    sk.write_daily_features(v.where("date = '2024-01-05'").limit(1), path)
    left = spark.read.parquet(path)
    assert left.where("date = '2024-01-05'").count() == 1
    assert left.where("date <> '2024-01-05'").count() == v.where("date <> '2024-01-05'").count()


def test_prediction_log_appends_and_keeps_null_risk(spark, tmp_path):
    df = sk.prediction_log(spark.createDataFrame([(1, 0.70004), (2, None), (3, 1.7)], "participant_id long, risk_score double"))
    for _ in range(2):
        sk.append_predictions(df, str(tmp_path / "log"))
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 6
    assert sorted({(x["participant_id"], x["risk_score"], x["risk_pattern"]) for x in lines}, key=lambda t: t[0]) == [(1, 0.7, "elevated"), (2, None, "incomplete"), (3, 1.0, "elevated")]


def test_participant_filter_reaches_the_scan(spark, sf):
    mine = rd.read_participant({"orders": tb.table(spark, sf, "orders")}, 7, "o_custkey", "o_orderdate")["orders"]
    assert "EqualTo(o_custkey,7)" in mine._jdf.queryExecution().executedPlan().toString()


SESSION = "event_id long, participant_id long, modality string, timestamp timestamp, value double, quality_score double, session_id string, idempotency_key string"


def _rows(n, shift=0):
    t0 = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t = t0 + dt.timedelta(hours=7 * i + shift)
        out.append((i * 10 + shift, i % 3, ["typing", "voice"][i % 2], t, float(i % 11), 0.3 + (i % 7) / 10, f"s{i % 20}", f"k{i % 20}"))
    return out


def _stream(spark, folder):
    return spark.readStream.schema(SESSION).option("maxFilesPerTrigger", 1).parquet(folder)


def test_medians_follow_late_sessions(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path)
    first, late = spark.createDataFrame(_rows(40), SESSION), spark.createDataFrame(_rows(15, 3), SESSION)
    sink = jobs.DailyMedians(f"{root}/sessions", f"{root}/medians")
    first.coalesce(1).write.parquet(src)
    jobs.run_available(_stream(spark, src), sink, f"{root}/cp")
    late.coalesce(1).write.mode("append").parquet(src)
    jobs.run_available(_stream(spark, src), sink, f"{root}/cp")
    sink(late, 99)  # a replayed batch changes nothing
    both = first.unionByName(late).withColumn("date", F.to_date("timestamp"))
    want = dy.daily_medians(both.where(dy.passes_quality(both)), ["participant_id", "modality", "date"], ["value"])
    cols = ["participant_id", "modality", "date", "value", "n_sessions"]
    got = spark.read.parquet(f"{root}/medians").select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_upsert_is_insert_if_absent_and_replayable(spark, tmp_path):
    sink = jobs.UpsertSink(str(tmp_path / "store"), str(tmp_path / "audit"))
    a, b = spark.createDataFrame(_rows(30), SESSION), spark.createDataFrame(_rows(25, 1), SESSION)
    sink(a, 0)
    sink(b, 1)
    sink(b, 1)
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.count() == store.select("session_id").distinct().count() == 20
    audit = spark.read.parquet(str(tmp_path / "audit")).groupBy("batch_id", "resolution").count().collect()
    assert {(r["batch_id"], r["resolution"]): r["count"] for r in audit} == {(0, "local_inserted"): 20, (1, "server_wins"): 20}


def _unreadable(folder):
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"not a table")


def test_a_batch_opens_only_the_folders_it_touches(spark, tmp_path):
    rows = spark.createDataFrame(_rows(6), SESSION)
    medians = jobs.DailyMedians(str(tmp_path / "sessions"), str(tmp_path / "medians"))
    medians(rows.limit(0), 0)
    _unreadable(tmp_path / "sessions" / "date=1999-01-01")
    medians(rows, 1)
    medians(spark.createDataFrame(_rows(6, 1), SESSION), 2)
    assert spark.read.schema("event_id long, date date").parquet(str(tmp_path / "sessions")).where("date >= '2024-01-01'").count() == 12
    with pytest.raises(Exception, match="1999-01-01|not a Parquet file"):
        spark.read.schema("event_id long, date date").parquet(str(tmp_path / "sessions")).agg(F.max("event_id")).collect()

    store = jobs.UpsertSink(str(tmp_path / "store"), str(tmp_path / "audit"), buckets=1000)
    few = rows.where("session_id IN ('s1', 's2')")
    store(few.limit(0), 0)
    _unreadable(tmp_path / "store" / "bucket=1001" / "batch_id=0")
    store(few, 1)
    store(few, 2)
    audit = spark.read.parquet(str(tmp_path / "audit")).groupBy("batch_id", "resolution").count().collect()
    assert {(r["batch_id"], r["resolution"]): r["count"] for r in audit} == {(1, "local_inserted"): 2, (2, "idempotent_match"): 2}


def test_null_keys_and_days_have_a_defined_place(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "typing", None, 1.0, 0.9, None, "k"), (2, 1, "typing", dt.datetime(2024, 1, 1), 2.0, 0.9, "s", "k")], SESSION)
    jobs.DailyMedians(str(tmp_path / "sessions"), str(tmp_path / "medians"))(rows, 0)
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "medians")).collect()] == [2.0]
    store = jobs.UpsertSink(str(tmp_path / "store"), str(tmp_path / "audit"))
    store(rows, 0)
    store(rows, 0)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2]


def test_ingest_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(_rows(20) + _rows(20), SESSION).write.parquet(src)
    seen = []
    q = jobs.dedup_ingest(_stream(spark, src), "30 days").writeStream.foreachBatch(lambda d, i: seen.extend(r[0] for r in d.select("idempotency_key").collect()))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == sorted({f"k{i}" for i in range(20)})


def test_stateful_baseline_equals_the_batch_fold(spark, tmp_path, sf):
    """Two micro-batches through the state store end where one batch fold over all days ends; streaks match a loop."""
    hub, base = tb.calibrated(spark, sf)
    days = hub.where(F.col("date") > F.lit(tb.CALIBRATION_END)).drop("n_sessions")
    src = str(tmp_path / "hub")
    days.where("date <= '2024-01-25'").coalesce(1).write.parquet(src)
    days.where("date > '2024-01-25'").coalesce(1).write.mode("append").parquet(src)
    base.write.parquet(str(tmp_path / "base"))
    stored = spark.read.parquet(str(tmp_path / "base"))
    rows = []
    for part in ("date <= '2024-01-25'", "date > '2024-01-25'"):
        folder = str(tmp_path / "ordered")
        days.where(part).coalesce(1).write.mode("append").parquet(folder)
        s = spark.readStream.schema(days.schema).parquet(folder)
        q = jobs.adaptive_stream(s, stored).writeStream.foreachBatch(lambda d, i: rows.extend(d.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(rows, key=lambda r: r["date"]):
        last[r["participant_id"]] = (r["baseline_mean"], r["baseline_median"], r["baseline_std"], r["baseline_mad"], r["sample_count"])
    want = {r["participant_id"]: (r["baseline_mean"], r["baseline_median"], r["baseline_std"], r["baseline_mad"], r["sample_count"]) for r in bl.adaptive_baseline(days, base.join(days.select(*bl.SERIES).distinct(), bl.SERIES, "left_semi")).collect()}
    assert last == want and len(want) > 5
    runs = {}
    for r in sorted(rows, key=lambda r: (r["participant_id"], r["date"])):
        n = runs[r["participant_id"]] = runs.get(r["participant_id"], 0) + 1 if abs(r["z_score"]) > 2 else 0
        assert r["streak"] == n


def test_late_and_repeated_days_leave_the_state_alone(spark, tmp_path):
    hub, base = tb.calibrated(spark, "/root/testdata/sf0.001")
    base.limit(1).write.parquet(str(tmp_path / "base"))
    stored = spark.read.parquet(str(tmp_path / "base"))
    key = stored.select(*bl.SERIES).first()
    day = dt.date(2024, 2, 1)
    kind = "participant_id long, modality string, feature_name string, date date, value double, quality_score double"
    middle = float(stored.first()["baseline_median"])
    batches = [[(3, middle), (4, None)], [(2, middle + 1), (4, middle), (5, middle)]]
    rows, folder = [], str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame([(*key, day + dt.timedelta(i), v, 1.0) for i, v in batch], kind).coalesce(1).write.mode("append").parquet(folder)
        q = jobs.adaptive_stream(spark.readStream.schema(kind).parquet(folder), stored).writeStream.foreachBatch(lambda d, i: rows.extend(d.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["date"].day, r["status"]) for r in rows] == [(4, "updated"), (5, "missing"), (3, "late"), (5, "late"), (6, "updated")]
    assert [r["sample_count"] - rows[0]["sample_count"] for r in rows] == [0, 0, 0, 0, 1]


def test_late_correction_rewrites_the_series(spark, tmp_path):
    root = str(tmp_path)
    s = spark.createDataFrame(_rows(60), SESSION)
    medians = jobs.DailyMedians(f"{root}/sessions", f"{root}/medians")
    medians(s, 0)
    hub = spark.read.parquet(f"{root}/medians").withColumn("feature_name", F.lit("value"))
    bl.baseline_row(hub.drop("n_sessions")).write.parquet(f"{root}/base")
    fix = jobs.LateCorrection(f"{root}/medians", f"{root}/base", f"{root}/trend")
    fix(s, 0)
    late = spark.createDataFrame([(9001, 0, "typing", dt.datetime(2024, 1, 2, 1), 500.0, 0.9, "late", "late")], SESSION)
    medians(late, 1)
    fix(late, 1)
    got = jobs.latest_rows(spark.read.parquet(f"{root}/trend"), [*bl.SERIES, "date"]).drop("batch_id")
    hub = spark.read.parquet(f"{root}/medians").withColumn("feature_name", F.lit("value"))
    want = tr.longitudinal(hub, spark.read.parquet(f"{root}/base")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_compaction_computes_the_windows_once_and_alone(spark, tmp_path, monkeypatch):
    """A compacting batch unites stored rows: windows inside the union would run as few tasks as their bytes deserve."""
    root = str(tmp_path)
    medians = jobs.DailyMedians(f"{root}/sessions", f"{root}/medians")
    medians(spark.createDataFrame(_rows(60), SESSION), 0)
    hub = spark.read.parquet(f"{root}/medians").withColumn("feature_name", F.lit("value"))
    bl.baseline_row(hub.drop("n_sessions")).write.parquet(f"{root}/base")
    frame, plans = type(spark.range(0)), []
    real = frame.unionByName

    def union(self, other, *args, **kwargs):
        plans.append([df._jdf.queryExecution().optimizedPlan().toString() for df in (self, other)])
        return real(self, other, *args, **kwargs)

    monkeypatch.setattr(frame, "unionByName", union)
    fix = jobs.LateCorrection(f"{root}/medians", f"{root}/base", f"{root}/trend", keep=1)
    s = spark.createDataFrame(_rows(60), SESSION)
    fix(s, 0)
    assert not plans
    fix(s, 1)
    assert plans and not any("Window" in side for pair in plans for side in pair)


def test_versions_of_late_corrections_stay_bounded(spark, tmp_path):
    """Days come back out of order over many batches; a compacting batch and a replay of it keep every row."""
    root = str(tmp_path)
    batches = [spark.createDataFrame([r for r in _rows(90) if (r[0] * 7) % 6 == i], SESSION) for i in range(6)]
    medians = jobs.DailyMedians(f"{root}/sessions", f"{root}/medians")
    whole = spark.createDataFrame(_rows(90), SESSION).withColumn("date", F.to_date("timestamp")).withColumn("feature_name", F.lit("value"))
    hub = dy.daily_medians(whole.where(dy.passes_quality(whole)), [*bl.SERIES, "date"], ["value", "quality_score"])
    bl.baseline_row(hub.drop("n_sessions")).write.parquet(f"{root}/base")
    fix = jobs.LateCorrection(f"{root}/medians", f"{root}/base", f"{root}/trend", keep=2)
    for i, batch in enumerate(batches):
        medians(batch, i)
        fix(batch, i)
        assert len(list((tmp_path / "trend").glob("batch_id=*"))) <= 3
        if i == 4:  # a compacting batch, replayed
            fix(batch, i)
    fix(batches[0].limit(0), len(batches))
    got = jobs.latest_rows(spark.read.parquet(f"{root}/trend"), [*bl.SERIES, "date"]).drop("batch_id")
    want = tr.longitudinal(hub, spark.read.parquet(f"{root}/base")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > 20
