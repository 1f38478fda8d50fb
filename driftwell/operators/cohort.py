"""Cohort and dashboard queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numeric import round4, round_half_away
from driftwell.operators.baseline import SERIES


def dashboard_summary(participants: DataFrame, days: DataFrame, deviations: DataFrame, predictions: DataFrame, threshold: float = 1.5, tie: str = "prediction_id") -> DataFrame:
    """Three pre-aggregations joined to the participants; the latest prediction is a ``max_by``, not a sorted subquery."""
    key = "participant_id"
    total = days.groupBy(key).agg(F.count(F.lit(1)).alias("total_collection_days"))
    events = deviations.where(F.abs("deviation_score") >= threshold).groupBy(key).agg(F.count(F.lit(1)).alias("total_deviation_events"))
    last = predictions.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in predictions.columns if c != key]), F.struct("created_at", tie)).alias("latest")
    )
    out = participants.join(total, key, "left").join(events, key, "left").join(last, key, "left")
    return out.fillna(0, ["total_collection_days", "total_deviation_events"])


def cohort_list(df: DataFrame, risk_class: str | None = None, flag: str | None = None, search: str | None = None, fields: list[str] | None = None, sort: str = "risk-desc", limit: int | None = None, id_col: str = "participant_id", risk_col: str = "risk_index") -> DataFrame:
    """Filter by class, flag and case-insensitive substring over several fields, then order (id breaks ties).

    With a limit Spark plans a distributed top-k instead of a full sort.
    """
    out = df
    if risk_class:
        out = out.where(F.col("risk_class") == risk_class)
    if flag:
        out = out.where(F.col(flag))
    if search and search.strip():
        needle = search.strip().lower()
        hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in fields or []]
        out = out.where(reduce(lambda a, b: a | b, hits))
    order = {"risk-desc": [F.desc(risk_col), F.asc(id_col)], "risk-asc": [F.asc(risk_col), F.asc(id_col)], "id-asc": [F.asc(id_col)]}[sort]
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def facet_counts(df: DataFrame, classes: list[str], flag: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("all_rows"),
        *[F.count_if(F.col("risk_class") == c).alias(c) for c in classes],
        F.count_if(F.col(flag)).alias(flag),
    )


def active_models(df: DataFrame) -> DataFrame:
    """Version of the most recently created active entry per model."""
    return df.where("active").groupBy("model_name").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def audit_counts(df: DataFrame, action: str = "action_type") -> DataFrame:
    return df.groupBy(action).agg(F.count(F.lit(1)).alias("n"))


def trend_series(hub: DataFrame, baseline: DataFrame, as_of: str, days: int, threshold: float = 1.5) -> DataFrame:
    """One row per calendar day of the last ``days`` for every series; a day without a value stays null (a gap).

    The date filter reaches the hub scan before the spine join; the spine has ``days`` rows per series.
    """
    end = F.lit(as_of).cast("date")
    recent = hub.where((F.col("date") > F.date_sub(end, days)) & (F.col("date") <= end)).select(*SERIES, "date", "value")
    base = baseline.select(*SERIES, "baseline_mean", "baseline_std")
    spine = base.withColumn("date", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    mean, std = F.col("baseline_mean"), F.col("baseline_std")
    z = F.when(std > 0, (F.col("value") - mean) / std).otherwise(F.lit(0.0))
    return spine.join(recent, [*SERIES, "date"], "left").select(
        *SERIES,
        "date",
        "value",
        round4(mean - std).alias("band_low"),
        round4(mean + std).alias("band_high"),
        F.when(F.col("value").isNotNull(), F.abs(z) >= threshold).alias("deviated"),
    )


def compare(df: DataFrame, pairs: DataFrame, risk: str = "risk_index", key: str = "participant_id") -> DataFrame:
    """Risk difference of each listed pair (``a``, ``b``)."""
    left = df.select(F.col(key).alias("a"), F.col(risk).alias("_ra"))
    right = df.select(F.col(key).alias("b"), F.col(risk).alias("_rb"))
    delta: Column = round_half_away(F.col("_ra") - F.col("_rb"), 2)
    return pairs.join(left, "a").join(right, "b").select("a", "b", delta.alias("risk_delta"), F.abs(delta).alias("magnitude"))


def quality_panel(status: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded mean quality in percent over the modalities that have one."""
    # Whole ten-thousandths are averaged, so a tie rounds the same way in every run.
    parts = F.floor(F.col("quality_score") * 10000 + 0.5)
    pct = F.floor(F.sum(parts) / F.count(parts) / 100 + 0.5)
    return status.where(F.col("quality_score").isNotNull()).groupBy(*keys).agg(pct.alias("avg_quality_pct"))
