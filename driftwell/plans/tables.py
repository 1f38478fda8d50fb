"""The given tables seen through the data model: events are sessions, customers participants, orders predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import baseline as bl
from driftwell.operators import daily as dy
from driftwell.sources.readers import read_table
from driftwell.sources.series_store import stored_series

# Event type of the given table -> modality it stands for.
EVENT_MODALITY = {"click": "typing", "error": "voice", "purchase": "motor", "view": "visual", "signup": "sleep"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event: participant, modality, date, value and quality in [0, 0.99]."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    modality = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(m)) for e, m in EVENT_MODALITY.items()])
    return ev.select(
        "event_id",
        F.col("user_id").alias("participant_id"),
        modality.alias("modality"),
        "ts",
        F.to_date("ts").alias("date"),
        "value",
        k.alias("k"),
        (k / F.lit(100.0)).alias("quality_score"),
    )


def feature_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with the feature columns of their modality filled from value, k, hour and minute."""
    s = sessions(spark, sf).withColumns({"hh": F.hour("ts").cast("double"), "mm": F.minute("ts").cast("double"), "kk": F.col("k").cast("double")})

    def only(modality: str, column: str):
        return F.when(F.col("modality") == modality, F.col(column))

    return s.withColumns(
        {
            "typing_speed": only("typing", "value"),
            "std_inter_key_interval": only("typing", "kk"),
            "correction_rate": only("typing", "hh"),
            "jitter": only("voice", "value"),
            "shimmer": only("voice", "kk"),
            "hnr": only("voice", "hh"),
            "pitch_mean": only("voice", "mm"),
            "cadence": only("motor", "value"),
            "stride_interval_variability": only("motor", "kk"),
            "tapping_rate": only("motor", "hh"),
            "tremor_freq_dominant_hz": only("motor", "mm"),
            "blink_rate": only("visual", "value"),
            "gaze_stability": only("visual", "kk"),
            "reaction_time_mean": only("visual", "hh"),
            "sleep_duration": only("sleep", "hh"),
            "sleep_quality": only("sleep", "kk"),
            "score": only("sleep", "value"),
        }
    )


def hub(spark: SparkSession, sf: str, overall: bool = True) -> DataFrame:
    """Daily median of the accepted sessions: per participant over all modalities, or per modality."""
    s = sessions(spark, sf)
    if overall:
        s = s.withColumn("modality", F.lit("all"))
    long = s.where(dy.passes_quality(s)).withColumn("feature_name", F.lit("value"))
    return dy.daily_medians(long, [*bl.SERIES, "date"], ["value", "quality_score"])


CALIBRATION_END = "2024-01-20"


def baselines(h: DataFrame) -> DataFrame:
    """Baseline rows of the calibration period of a hub."""
    return bl.baseline_row(bl.in_period(h, end=CALIBRATION_END).drop("n_sessions"))


def calibrated(spark: SparkSession, sf: str, overall: bool = True) -> tuple[DataFrame, DataFrame]:
    """Hub and the baseline rows of its calibration period, both read from one store bucketed by series."""
    h = stored_series(hub(spark, sf, overall), bl.SERIES)
    return h, baselines(h)
