"""Streaming jobs over session rows (participant_id, modality, timestamp, value, quality_score, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwell.functions import fixed_values as fv
from driftwell.operators import baseline as bl
from driftwell.operators import daily as dy
from driftwell.operators import sync as sy
from driftwell.operators import trend as tr
from driftwell.session import scratch_folder


def dedup_ingest(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """First arrival per idempotency key within the lateness bound; older keys leave the state."""
    return stream.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["idempotency_key"])


def daily_counts(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Tumbling day roll-up of the mergeable statistics. Exact medians are recomputed per touched day (``DailyMedians``)."""
    ok = F.coalesce(F.col("quality_score") >= fv.MIN_QUALITY, F.lit(False))
    return (
        stream.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("day"), "participant_id", "modality")
        .agg(F.count(F.lit(1)).alias("total_count"), F.count_if(ok).alias("passed_count"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("participant_id", "modality", F.to_date("day.start").alias("date"), "total_count", "passed_count", "low", "high")
    )


def sliding_concern(stream: DataFrame, lateness: str = "7 days", threshold: int = 2) -> DataFrame:
    """Distinct days with a reported movement in every 7-day window sliding by a day; the set holds at most 7 dates."""
    day = F.to_date("timestamp")
    return (
        stream.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "7 days", "1 day").alias("w"), "participant_id")
        .agg(F.size(F.collect_set(F.when(tr.reported_movement(stream), day))).alias("positive_days"))
        .select("participant_id", F.to_date("w.start").alias("window_start"), "positive_days", (F.col("positive_days") >= threshold).alias("flagged"))
    )


# ---- foreachBatch sinks ----------------------------------------------------------------------------------------

def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or ""):
            return spark.createDataFrame([], like.schema)
        raise


def touched(batch: DataFrame, column: str) -> list:
    """The distinct values of a partition column in a batch, for use as literals: a filter on literals selects folders
    before anything is read, which a join does not. The column must have few values whatever the input: days, or a fixed
    number of buckets."""
    return [r[0] for r in batch.select(column).distinct().where(F.col(column).isNotNull()).collect()]


class DailyMedians:
    """Recomputes the median of every (participant, day) a batch touches, late ones included.

    Accepted sessions are stored partitioned by date; a batch reads only the folders of the dates it touches and replaces
    their partitions in the result, so replaying a batch gives the same files. Sessions without a timestamp have no day and
    are left out; a batch without sessions changes nothing.
    """

    def __init__(self, sessions_path: str, result_path: str):
        self.sessions_path, self.result_path = sessions_path, result_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("date", F.to_date("timestamp")).dropDuplicates(["event_id"])
        # Partitions are replaced whole, so every participant of a touched date is recomputed; other dates are not read.
        days = touched(new, "date")
        if not days:
            return
        on_days = F.col("date").isin(days)
        new = new.where(on_days)
        stored = _read(spark, self.sessions_path, new.select(*[c for c in new.columns if c != "date"], "date")).where(on_days)
        fresh = new.join(stored.select("event_id", "date"), ["event_id", "date"], "left_anti")
        fresh.select(*stored.columns).write.mode("append").partitionBy("date").parquet(self.sessions_path)
        current = spark.read.schema(stored.schema).parquet(self.sessions_path).where(on_days)
        result = dy.daily_medians(current.where(dy.passes_quality(current)), ["participant_id", "modality", "date"], ["value", "quality_score"])
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self.result_path)


def _versions(spark: SparkSession, path: str) -> dict[int, object]:
    """Batch numbers of the version folders below ``path`` with their places."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    folders = [status.getPath() for status in files.listStatus(root) if status.isDirectory() and status.getPath().getName().startswith("batch_id=")]
    return {int(f.getName().removeprefix("batch_id=")): f for f in folders}


class LateCorrection:
    """After a day changed, recomputes the trend rows of the affected series from that day on.

    Windows look back only, so earlier rows of a series stay; later ones may change as far as a run of deviations lasts.  The
    result must be kept from the first batch on.  A batch writes one version, a folder named by its number; readers take the
    newest version per row (``latest_rows``).  With ``keep`` older versions present a batch also carries over every row it does
    not replace, and the older folders go, so the store holds the current rows and at most ``keep`` batches of changes.
    A batch that is cut off before its folder is complete leaves the older ones; one that is replayed keeps what its first
    attempt had carried over.  Rows without a day or series change nothing.
    """

    def __init__(self, medians_path: str, baseline_path: str, result_path: str, keep: int = 8):
        self.medians_path, self.baseline_path, self.result_path, self.keep = medians_path, baseline_path, result_path, keep

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = ["participant_id", "modality"]
        since = batch.where("timestamp is not null").groupBy(*keys).agg(F.min(F.to_date("timestamp")).alias("__since"))
        hub = spark.read.parquet(self.medians_path).withColumn("feature_name", F.lit("value")).join(since, keys)
        rows = tr.longitudinal(hub, spark.read.parquet(self.baseline_path), carry=["__since"])
        rows = rows.where(F.col("date") >= F.col("__since")).drop("__since").withColumn("batch_id", F.lit(batch_id))
        versions = _versions(spark, self.result_path)
        older = [place for n, place in versions.items() if n < batch_id]
        compact, replayed = len(older) >= self.keep, batch_id in versions
        if compact or replayed:
            row = [*bl.SERIES, "date"]
            # Computed once and by all cores: in a union adaptive execution leaves the windows as few tasks as their bytes deserve.
            rows = self._stored(rows)
            held = spark.read.schema(rows.schema).parquet(self.result_path)
            held = held.where(F.col("batch_id") <= batch_id) if compact else held.where(F.col("batch_id") == batch_id)
            carried = latest_rows(held, row).join(rows.select(*row), row, "left_anti")
            rows = rows.unionByName(carried.withColumn("batch_id", F.lit(batch_id)))
        # One partition per batch: a replayed batch replaces its own rows.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.result_path)
        if compact and batch_id in _versions(spark, self.result_path):
            for place in older:
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    @staticmethod
    def _stored(rows: DataFrame) -> DataFrame:
        """``rows``, written to a folder of their own that goes when the driver ends."""
        spark, path = rows.sparkSession, scratch_folder(rows.sparkSession, "corrected")
        rows.write.parquet(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        return spark.read.schema(rows.schema).parquet(path)


def latest_rows(df: DataFrame, keys: list[str], version: str = "batch_id") -> DataFrame:
    """Newest version of every row of a result written by ``LateCorrection`` or ``UpsertSink``."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_r")).select(*keys, "_r.*")


class UpsertSink:
    """Server-wins upsert: a batch adds only the sessions the store does not have.

    The store is partitioned by a bucket of the key's hash and by batch. A batch reads the folders of the buckets its keys fall
    into, and a replayed batch replaces its own rows; the audit of each item is written beside it. ``buckets`` belongs to the
    store and must not change; more of them let a small batch read less and write more files. A null key matches nothing
    and is kept once per batch.
    """

    def __init__(self, store_path: str, audit_path: str, key: str = "session_id", buckets: int = 64):
        self.store_path, self.audit_path, self.key, self.buckets = store_path, audit_path, key, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        first = batch.groupBy(self.key).agg(F.min(F.struct(*[c for c in batch.columns if c != self.key])).alias("_r")).select(self.key, "_r.*")
        like = batch.withColumns({"bucket": bucket, "batch_id": F.lit(batch_id)})
        hit = touched(like, "bucket")
        if not hit:
            return
        server = _read(spark, self.store_path, like).where(F.col("bucket").isin(hit) & (F.col("batch_id") != batch_id)).drop("bucket", "batch_id")
        audit = sy.sync_audit(sy.reconcile(first, server, self.key), self.key).withColumn("batch_id", F.lit(batch_id))
        fresh = first.join(server.select(self.key), self.key, "left_anti").withColumns({"bucket": bucket, "batch_id": F.lit(batch_id)})
        audit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.audit_path)
        by_bucket = fresh.repartition("bucket")  # one file per bucket and batch
        by_bucket.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(self.store_path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is available now and stops; the checkpoint makes the next call continue."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# ---- stateful baseline and streak ------------------------------------------------------------------------------

STATE = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("mean", "median", "std", "mad")] + [T.StructField(n, T.LongType()) for n in ("n", "streak")]
    + [T.StructField("last", T.DateType())]
)
OUTPUT = T.StructType(
    [T.StructField("participant_id", T.LongType()), T.StructField("modality", T.StringType()), T.StructField("feature_name", T.StringType()), T.StructField("date", T.DateType()), T.StructField("status", T.StringType())]
    + [T.StructField(f"baseline_{n}", T.DoubleType()) for n in ("mean", "median", "std", "mad")]
    + [T.StructField("sample_count", T.LongType()), T.StructField("z_score", T.DoubleType()), T.StructField("streak", T.LongType())]
)


def _r4(x: float) -> float:
    scaled = int(abs(x) * 1e4 + 0.5) / 1e4
    return -scaled if x < 0 and scaled else scaled


class AdaptiveBaseline(StatefulProcessor):
    """Exponentially weighted baseline and deviation streak per series: six numbers and the last date of state.

    The first row of a series carries its calibrated baseline (columns ``init_*``); later days are applied in date order
    within a batch. The step equals the batch fold. A day not after the last one applied - late, or sent twice - leaves the
    state as it is and comes out with status 'late', to be recomputed from the stored days (``LateCorrection``). A null value
    breaks the streak and changes nothing else.
    """

    def __init__(self, alpha: float = fv.EWMA_ALPHA):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("date")
        if self.state.exists():
            mean, median, std, mad, n, streak, last = self.state.get()
        else:
            first = days.iloc[0]
            mean, median, std, mad, n, streak = (*(float(first[f"init_{c}"]) for c in ("mean", "median", "std", "mad")), int(first["init_n"]), 0)
            last = None
        out = []
        for date, v, q in zip(days["date"], days["value"], days["quality_score"]):
            if last is not None and date <= last:
                out.append((*key, date, "late", mean, median, std, mad, n, None, streak))
                continue
            last = date
            if v is None or v != v:
                streak = 0
                out.append((*key, date, "missing", mean, median, std, mad, n, None, streak))
                continue
            z = self._z(v, mean, median, std, mad)
            streak = streak + 1 if abs(z) > fv.SUSTAINED_Z else 0
            spread = mad if mad > 0 else (_r4(std * fv.STD_TO_MAD) if std > 0 else fv.MIN_DISPERSION)
            if q < fv.MIN_QUALITY:
                status = "rejected_low_quality"
            elif _r4(abs(v - median) / spread) > fv.OUTLIER_MAD:
                status = "rejected_outlier"
            else:
                status, keep = "updated", 1.0 - self.alpha
                mean, median = _r4(self.alpha * v + keep * mean), _r4(self.alpha * v + keep * median)
                std = _r4((self.alpha * (v - mean) * (v - mean) + keep * std * std) ** 0.5)
                mad, n = _r4(self.alpha * abs(v - median) + keep * mad), n + 1
            out.append((*key, date, status, mean, median, std, mad, n, z, streak))
        self.state.update((mean, median, std, mad, n, streak, last))
        yield pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields])

    @staticmethod
    def _z(v: float, mean: float, median: float, std: float, mad: float) -> float:
        if std > fv.DISPERSION_EPSILON:
            return _r4((v - mean) / std)
        if mad > fv.DISPERSION_EPSILON:
            return _r4(fv.STD_TO_MAD * (v - median) / mad)
        if abs(v - median) < fv.DISPERSION_EPSILON:
            return 0.0
        return fv.EXTREME_Z if v >= median else -fv.EXTREME_Z

    def close(self) -> None:
        pass


def adaptive_stream(hub_stream: DataFrame, baseline: DataFrame, alpha: float = fv.EWMA_ALPHA) -> DataFrame:
    """Stream of hub rows joined to the stored baselines (stream-static) and folded per series."""
    init = baseline.where("sample_count > 0").select(
        *bl.SERIES,
        *[F.col(f"baseline_{n}").alias(f"init_{n}") for n in ("mean", "median", "std", "mad")],
        F.col("sample_count").cast("long").alias("init_n"),
    )
    rows = hub_stream.withColumn("quality_score", F.coalesce("quality_score", F.lit(1.0)))
    return (
        rows.join(init, bl.SERIES)
        .groupBy(*bl.SERIES)
        .transformWithStateInPandas(statefulProcessor=AdaptiveBaseline(alpha), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    )
