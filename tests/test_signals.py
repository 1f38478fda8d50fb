import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import signals as sg
from driftwell.operators.ordered import sequenced
from driftwell.operators.spectrum import power_bins


def test_chunked_neighbours_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(s, i, t, float(rng.randint(0, 9))) for s in (1, 2) for i, t in enumerate(sorted(rng.sample(range(5000), 120)))]
    df = spark.createDataFrame(rows, "s long, i long, t long, v double")
    got = sequenced(df, ["s"], "t", 700, ["v"], {"total": F.col("v")})
    want = df.selectExpr(
        "s", "i", "row_number() over (partition by s order by t) - 1 as idx", "lag(v) over (partition by s order by t) as p",
        "lead(v) over (partition by s order by t) as n", "sum(v) over (partition by s order by t) as total",
    )
    a = sorted(map(tuple, got.select("s", "i", "idx", "prev_v", "next_v", "total").collect()))
    assert a == sorted(map(tuple, want.collect()))


def test_refractory_equals_greedy_loop(spark):
    rng = random.Random(5)
    times = sorted(rng.sample(range(20_000), 300))
    df = spark.createDataFrame([("r", t) for t in times], "session_id string, t_ms long")
    got = sorted(r["t_ms"] for r in sg.refractory(df, "session_id", 250.0, 3000.0).collect())
    want, last = [], -math.inf
    for t in times:
        if t - last >= 250:
            want.append(float(t))
            last = t
    assert got == want


def test_samples_are_never_partitioned_by_recording_alone(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("session_id"), (F.col("id") * 20).alias("t_ms"), *[F.sin(F.col("id") * 0.7).alias(c) for c in ("ax", "ay", "az")])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seq = sequenced(sg.with_magnitude(df), ["session_id"], "t_ms", 1000.0, ["mag"], carried=sg.signal_moments(sg.with_magnitude(df), "session_id", "mag"))
        plan = seq._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in plan.splitlines() if "Join" in line]
    # The one join on the recording alone adds statistics to the rows of chunks, which lie below the join with the samples.
    assert len(joins) == 2 and "_chunk" in joins[0] and "_chunk" not in joins[1]
    assert seq.where(F.abs("mean") >= 0).count() == 5000


def _greedy(times, gap):
    out, last = [], -math.inf
    for t in times:
        if t >= last + gap:
            out.append(float(t))
            last = t
    return out


@pytest.mark.parametrize("spread", [20, 200, 600])
def test_refractory_follows_runs_over_many_chunks(spark, spread):
    rng = random.Random(spread)
    recordings = {}
    for name in ("a", "b", "c"):
        t, times = rng.randint(-5000, 0), []
        for _ in range(600):
            t += rng.randint(0, spread)
            times.append(t)
        recordings[name] = times
    df = spark.createDataFrame([(k, t) for k, times in recordings.items() for t in times], "session_id string, t_ms long")
    got = sorted(map(tuple, sg.refractory(df, "session_id", 250.0, 800.0).collect()))
    assert got == [(k, t) for k in sorted(recordings) for t in _greedy(recordings[k], 250)]
    assert sg.refractory(df.where("false"), "session_id", 250.0, 800.0).count() == 0


def test_one_run_without_a_pause_is_spread_over_tasks(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("r").alias("session_id"), (F.col("id") * 9 + F.pmod(F.xxhash64("id"), F.lit(9))).alias("t_ms"))
    # Without this setting adaptive execution joins the few megabytes of the test into one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sg.refractory(df, "session_id", 250.0, 20_000.0)
        rows = got.select("t_ms", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    times = sorted(r["t_ms"] for r in df.select("t_ms").collect())
    assert sorted(r["t_ms"] for r in rows) == _greedy(times, 250)
    tasks = {}
    for r in rows:
        tasks[r["p"]] = tasks.get(r["p"], 0) + 1
    assert max(tasks.values()) < 0.6 * len(rows)


def test_spectrum_of_split_series_equals_numpy(spark):
    rng = np.random.default_rng(4)
    lengths = {"a": 16, "b": 500, "c": 3000}
    series = {k: rng.normal(size=(2, n)) for k, n in lengths.items()}
    rows = [(k, 1 << (n - 1).bit_length(), i, *map(float, series[k][:, i])) for k, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, size long, i long, u double, v double")
    for single, block in ((4096, 1 << 16), (64, 128), (8, 1)):
        got = {(r["k"], r["bin"]): (r["u"], r["v"]) for r in power_bins(df, ["k", "size"], "size", "i", ["u", "v"], 0.01, 0.5, single, block).collect()}
        want = {}
        for k, n in lengths.items():
            size = 1 << (n - 1).bit_length()
            power = np.abs(np.fft.rfft(series[k], size, axis=1)) ** 2
            want |= {(k, b): tuple(power[:, b]) for b in range(math.ceil(0.01 * size), size // 2 + 1)}
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[b] for b in want], list(want.values()), rtol=1e-9, atol=1e-9)
    assert power_bins(df.where("false"), ["k", "size"], "size", "i", ["u", "v"], 0.01, 0.5).count() == 0


def test_step_regularity_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(300) * 2 * np.pi / 60) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "k string, idx long, v double")
    d = x - x.mean()
    acf = np.correlate(d, d, "full")[299:]
    want = (acf / acf[0])[20:250].max()
    for block in (32, 1024):
        got = sg.step_regularity(df, "k", "v", 100.0, block=block).first()["step_regularity"]
        assert got == pytest.approx(want, abs=1e-4)


def test_stance_and_swing(spark):
    signal = [0] * 5 + [100] * 60 + [0] * 40 + [100] * 60 + [0] * 300 + [100] * 5 + [0] * 30
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(signal)], "k string, idx long, v double")
    rows = sg.stance_swing(df, "k", "v", 100.0, chunk=50.0).orderBy("swing_s").collect()
    # The second stance has a swing of 3 s (too long); the third stance of 0.05 s is too short.
    assert [(r["stance_s"], r["swing_s"]) for r in rows] == [(0.6, None), (0.6, 0.4)]


def test_blinks(spark):
    ear = [0.3] * 5 + [0.1] * 3 + [0.3] * 20 + [0.1] * 1 + [0.3] * 20 + [0.1] * 4
    df = spark.createDataFrame([("s", i * 40, v) for i, v in enumerate(ear)], "session_id string, t_ms long, ear double")
    row = sg.blink_features(df, chunk=300.0).first()
    # 120 ms, then a 40 ms flutter that is dropped, then a run open at the end (120 ms to the last sample).
    assert row["blink_count"] == 2 and row["blink_duration_mean"] == 120.0


def test_tapping_of_a_steady_rhythm(spark):
    df = spark.createDataFrame([("s", i * 200) for i in range(30)], "session_id string, t_ms long")
    row = sg.tapping_features(df, chunk=1000.0).first()
    assert (row["interval_mean"], row["interval_variability"], row["decline_slope"], row["status"]) == (200.0, 0.0, 0.0, "ok")
    short = spark.createDataFrame([("s", 0), ("s", 200)], "session_id string, t_ms long")
    row = sg.tapping_features(short).first()
    assert row["status"] == "insufficient_taps" and row["tapping_rate"] is None


def test_tremor_finds_the_tone(spark):
    n = 256
    rows = [("s", i * 20, 9.0 + math.sin(2 * math.pi * 6.25 * i / 50), 0.0, 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, t_ms long, ax double, ay double, az double")
    row = sg.tremor_spectrum(df, chunk=1000.0).first()
    assert row["dominant_frequency"] == 6.25
    assert row["pathological"] > 0.99
    assert row["tremor_amplitude"] == pytest.approx(1 / math.sqrt(2), abs=1e-3)


def test_typing_intervals(spark):
    t = [0, 100, 300, 1000]
    df = spark.createDataFrame([("s", x, x == 300) for x in t], "session_id string, t_ms long, is_correction boolean")
    row = sg.typing_features(df).first()
    assert row["mean_inter_key_interval"] == 333.33 and row["typing_speed"] == 4.0
    assert row["pause_rate"] == 60.0 and row["correction_rate"] == 60.0
    assert row["std_inter_key_interval"] == pytest.approx(np.std([100, 200, 700], ddof=1), abs=0.01)


def test_a_short_recording_is_reported(spark):
    rows = [("long", 20.0 * i, math.sin(2 * math.pi * 5 * 0.02 * i), 0.0, 0.0) for i in range(128)] + [("short", 20.0 * i, 1.0, 0.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "session_id string, t_ms double, ax double, ay double, az double")
    got = {r["session_id"]: r for r in sg.tremor_spectrum(df, chunk=1000.0).collect()}
    assert got["long"]["status"] == "ok"
    assert got["short"]["status"] == "insufficient_samples" and got["short"]["dominant_frequency"] is None
