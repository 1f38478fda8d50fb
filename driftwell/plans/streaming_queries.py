"""S: the streaming jobs over the events as a file stream, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import baseline as bl
from driftwell.operators import projections as pj
from driftwell.plans import tables as tb
from driftwell.plans.baseline_queries import ADAPTIVE, AFTER
from driftwell.plans.registry import query
from driftwell.plans.sqltext import SESSIONS, mdn, r4
from driftwell.plans.trend_queries import LONGITUDINAL, TREND
from driftwell.session import scratch_folder
from driftwell.streaming import jobs


def stream(spark, sf, batches=1):
    """The events of the given table as a stream of session rows; each micro-batch takes whole files.

    With several ``batches`` the table is dealt by the hash of its key first, so that most days come back in every batch.
    """
    like = tb.table(spark, sf, "events")
    if batches == 1:
        raw = spark.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        folder = scratch_folder(spark, "dealt")
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches)
        like.repartition(files, "event_id").write.parquet(folder)
        raw = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(folder)
    k = F.get_json_object("props", "$.k").cast("int")
    modality = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(m)) for e, m in tb.EVENT_MODALITY.items()])
    return raw.select(
        "event_id",
        F.col("user_id").alias("participant_id"),
        modality.alias("modality"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "value",
        k.alias("k"),
        (k / 100.0).alias("quality_score"),
    )


def collected(df, spark, keys, name, mode="append"):
    """Runs a stream into a folder, one partition per batch, and reads the newest version of each row."""
    root = scratch_folder(spark, name)

    def sink(batch, batch_id):
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return jobs.latest_rows(spark.read.parquet(f"{root}/out"), keys).drop("batch_id")


@query("S1_dedup_ingest", f"WITH {SESSIONS} SELECT DISTINCT 'idmp_' || substr(sha256(modality || '_' || participant_id || '_' || CAST(date AS VARCHAR)), 1, 32) AS idempotency_key FROM sessions")
def dedup_ingest(spark, sf):
    keyed = stream(spark, sf).withColumn("idempotency_key", pj.idempotency_key(F.col("modality"), F.col("participant_id"), F.to_date("timestamp")))
    return collected(jobs.dedup_ingest(keyed), spark, ["idempotency_key"], "dedup").select("idempotency_key")


@query(
    "S2_daily_counts",
    f"WITH {SESSIONS} SELECT participant_id, modality, CAST(date AS VARCHAR) AS date, count(*) AS total_count, count(*) FILTER (quality_score >= 0.5) AS passed_count, min(value) AS low, max(value) AS high FROM sessions GROUP BY participant_id, modality, date",
)
def daily_counts(spark, sf):
    return collected(jobs.daily_counts(stream(spark, sf)), spark, ["participant_id", "modality", "date"], "daily", "update")


def _medians(spark, sf):
    root = scratch_folder(spark, "medians")
    sink = jobs.DailyMedians(f"{root}/sessions", f"{root}/medians")
    jobs.run_available(stream(spark, sf), sink, f"{root}/checkpoint")
    return root, spark.read.parquet(f"{root}/medians")


@query(
    "S2_daily_medians",
    f"""WITH {SESSIONS} SELECT participant_id, modality, CAST(date AS VARCHAR) AS date, {r4(mdn("value"))} AS value, count(*) AS n_sessions
FROM sessions WHERE quality_score >= 0.5 GROUP BY participant_id, modality, date""",
)
def daily_medians(spark, sf):
    return _medians(spark, sf)[1].select("participant_id", "modality", "date", "value", "n_sessions")


@query(
    "S3_sliding_concern",
    f"""WITH {SESSIONS}, d AS (SELECT participant_id, date, max(CAST(k >= 60 AS BIGINT)) AS yes FROM sessions WHERE modality = 'sleep' GROUP BY ALL),
w AS (SELECT participant_id, CAST(date - CAST(unnest(range(7)) AS INTEGER) AS DATE) AS window_start, yes FROM d)
SELECT participant_id, CAST(window_start AS VARCHAR) AS window_start, CAST(sum(yes) AS BIGINT) AS positive_days, sum(yes) >= 2 AS flagged FROM w GROUP BY participant_id, window_start""",
)
def sliding_concern(spark, sf):
    sleep = stream(spark, sf).where("modality = 'sleep'").withColumn("unusual_movement_self_report", F.col("k") >= 60)
    return collected(jobs.sliding_concern(sleep), spark, ["participant_id", "window_start"], "concern", "update")


def _adaptive(spark, sf):
    """The hub rows after calibration as a file stream through the stateful baseline."""
    root = scratch_folder(spark, "adaptive")
    hub, base = tb.calibrated(spark, sf)
    hub.where(AFTER).drop("n_sessions").write.parquet(f"{root}/hub")
    base.write.parquet(f"{root}/baseline")
    rows = spark.readStream.schema(spark.read.parquet(f"{root}/hub").schema).parquet(f"{root}/hub")
    out = jobs.adaptive_stream(rows, spark.read.parquet(f"{root}/baseline"))
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return collected(out, spark, [*bl.SERIES, "date"], "fold")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)


@query("S4_adaptive_baseline", f"WITH {ADAPTIVE} SELECT participant_id, mean AS baseline_mean, median AS baseline_median, std AS baseline_std, mad AS baseline_mad, n AS sample_count FROM folded")
def adaptive_baseline(spark, sf):
    last = _adaptive(spark, sf).groupBy("participant_id").agg(F.max_by(F.struct("baseline_mean", "baseline_median", "baseline_std", "baseline_mad", "sample_count"), "date").alias("r"))
    return last.select("participant_id", "r.*")


@query(
    "S5_streak_state",
    f"""WITH {ADAPTIVE},
before AS (SELECT d.participant_id, d.date, d.i, d.v, s.mean, s.median, s.std, s.mad FROM fold s JOIN days d ON d.participant_id = s.participant_id AND d.i = s.i + 1),
scored AS (SELECT *, CASE WHEN std > 1e-6 THEN {r4("((v-mean)/std)")} WHEN mad > 1e-6 THEN {r4("(0.6745::DOUBLE*(v-median)/mad)")}
  WHEN abs(v-median) < 1e-6 THEN 0e0 WHEN v >= median THEN 1e1 ELSE -1e1 END AS z_score FROM before)
SELECT participant_id, CAST(date AS VARCHAR) AS date, z_score,
       i - coalesce(max(CASE WHEN abs(z_score) <= 2 THEN i END) OVER (PARTITION BY participant_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS streak
FROM scored""",
)
def streak_state(spark, sf):
    return _adaptive(spark, sf).select("participant_id", "date", "z_score", "streak")


@query(
    "S6_upsert_sink",
    f"WITH {SESSIONS} SELECT participant_id || '-' || modality || '-' || CAST(date AS VARCHAR) AS session_id, min(event_id) AS event_id FROM sessions GROUP BY participant_id, modality, date",
)
def upsert_sink(spark, sf):
    root = scratch_folder(spark, "upsert")
    session = F.concat_ws("-", F.col("participant_id").cast("string"), "modality", F.to_date("timestamp").cast("string"))
    rows = stream(spark, sf).select(session.alias("session_id"), "event_id", "participant_id", "value")
    jobs.run_available(rows, jobs.UpsertSink(f"{root}/store", f"{root}/audit"), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/store").select("session_id", "event_id")


LATE = f"""WITH {LONGITUDINAL.replace("'all' AS modality", "modality").replace("GROUP BY participant_id, date)", "GROUP BY participant_id, modality, date)")}
SELECT participant_id, modality, feature_name, CAST(date AS VARCHAR) AS date, value AS daily_value, seven_day_average, fourteen_day_trend, {TREND} AS trend_label FROM fin"""


def _corrected(spark, path):
    rows = jobs.latest_rows(spark.read.parquet(path), [*bl.SERIES, "date"])
    return rows.select(*bl.SERIES, "date", "daily_value", "seven_day_average", "fourteen_day_trend", "trend_label")


@query("S7_late_correction", LATE)
def late_correction(spark, sf):
    root, medians = _medians(spark, sf)
    hub = medians.withColumn("feature_name", F.lit("value"))
    tb.baselines(hub).write.parquet(f"{root}/baseline")
    sink = jobs.LateCorrection(f"{root}/medians", f"{root}/baseline", f"{root}/trend")
    jobs.run_available(stream(spark, sf), sink, f"{root}/late")
    return _corrected(spark, f"{root}/trend")


@query("S7_late_batches", LATE)
def late_batches(spark, sf):
    """Three micro-batches whose days overlap: each changes medians and corrects the trends; the third one compacts."""
    root = scratch_folder(spark, "late")
    tb.baselines(tb.hub(spark, sf, overall=False)).write.parquet(f"{root}/baseline")
    medians = jobs.DailyMedians(f"{root}/sessions", f"{root}/medians")
    fix = jobs.LateCorrection(f"{root}/medians", f"{root}/baseline", f"{root}/trend", keep=2)

    def sink(batch, batch_id):
        medians(batch, batch_id)
        fix(batch, batch_id)

    jobs.run_available(stream(spark, sf, batches=3), sink, f"{root}/checkpoint")
    return _corrected(spark, f"{root}/trend")
