"""Daily deviation, sustained runs and trends.

Every window here uses one specification - partition by series, order by date - so Spark plans a single exchange and
a single sort for the whole stage.  A series has at most one row per date, hence a bounded partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.functions.numeric import clamp, exact_sum, finite, round4, round_half_away
from driftwell.operators.baseline import SERIES, with_baseline


def by_date(keys: list[str] = SERIES):
    return W.partitionBy(*keys).orderBy("date")


# ---- deviation -------------------------------------------------------------------------------------------------

def deviation_columns(value: Column) -> dict[str, Column]:
    """z-score ladder: sample deviation, else MAD, else 0 at the centre, else +-10; with the method used."""
    v = finite(value)
    mean, std = finite(F.col("baseline_mean")), F.coalesce(finite(F.col("baseline_std")), F.lit(0.0))
    median = F.coalesce(finite(F.col("baseline_median")), mean, F.lit(0.0))
    mad = F.coalesce(finite(F.col("baseline_mad")), F.lit(0.0))
    known = F.coalesce(
        F.col("baseline_mean"), F.col("baseline_median"), F.col("baseline_std"), F.col("baseline_mad")
    ).isNotNull()
    parametric = (std > fv.DISPERSION_EPSILON) & mean.isNotNull()
    robust = mad > fv.DISPERSION_EPSILON
    off = v - median
    method = (
        F.when(v.isNull(), "invalid_value")
        .when(~known, "missing_baseline")
        .when(parametric, "parametric_std")
        .when(robust, "mad_fallback")
        .when(F.abs(off) < fv.DISPERSION_EPSILON, "zero_dispersion")
        .otherwise("zero_dispersion_extreme")
    )
    usable = v.isNotNull() & known
    z = F.when(
        usable,
        F.when(parametric, round4((v - mean) / std))
        .when(robust, round4(F.lit(fv.STD_TO_MAD) * off / mad))
        .when(F.abs(off) < fv.DISPERSION_EPSILON, F.lit(0.0))
        .when(off >= 0, F.lit(fv.EXTREME_Z))
        .otherwise(F.lit(-fv.EXTREME_Z)),
    )
    centre = F.when(usable, round4(F.when(parametric, mean).otherwise(median)))
    diff = F.when(
        usable,
        F.when(parametric, round4(v - mean))
        .when(robust | (F.abs(off) >= fv.DISPERSION_EPSILON), round4(off))
        .otherwise(F.lit(0.0)),
    )
    return {"z_score": z, "method": method, "baseline_value": centre, "diff": diff}


def deviation(obs: DataFrame, baseline: DataFrame) -> DataFrame:
    joined = with_baseline(obs, baseline)
    return joined.withColumns(deviation_columns(F.col("value")))


def deviation_record(dev: DataFrame, algorithm_version: str = "1.1.0") -> DataFrame:
    """Storage row: absent scores become 0 and the quality is clamped."""
    trend = F.col("trend_score") if "trend_score" in dev.columns else F.lit(0.0)
    return dev.select(
        "participant_id",
        "date",
        "modality",
        "feature_name",
        round4(F.col("value")).alias("value"),
        F.coalesce("baseline_value", F.lit(0.0)).alias("baseline_value"),
        F.coalesce("z_score", F.lit(0.0)).alias("deviation_score"),
        round4(F.coalesce(trend, F.lit(0.0))).alias("trend_score"),
        round4(clamp(F.coalesce(F.col("quality_score"), F.lit(1.0)), 0, 1)).alias("quality_score"),
        F.lit(algorithm_version).alias("algorithm_version"),
    )


def deviation_label(z: Column, streak: Column | None = None) -> Column:
    size = F.abs(finite(z))
    sustained = F.lit(False) if streak is None else (size > fv.SUSTAINED_Z) & (streak >= fv.SUSTAINED_DAYS)
    return (
        F.when(size.isNull(), fv.LABEL_WITHIN)
        .when(sustained, fv.LABEL_SUSTAINED)
        .when(size < 1.5, fv.LABEL_WITHIN)
        .when(size < 2.0, fv.LABEL_MILD)
        .when(size < 3.0, fv.LABEL_MODERATE)
        .otherwise(fv.LABEL_SIGNIFICANT)
    )


def severity(z: Column, streak: Column | None = None) -> Column:
    size = F.coalesce(F.abs(finite(z)), F.lit(0.0))
    sustained = F.lit(False) if streak is None else (size > fv.SUSTAINED_Z) & (streak >= fv.SUSTAINED_DAYS)
    return F.when(sustained, 4).when(size < 1.5, 0).when(size < 2.0, 1).when(size < 3.0, 2).otherwise(3)


def classify(dev: DataFrame, streak: str | None = None) -> DataFrame:
    s = F.col(streak) if streak else None
    return dev.withColumns({"label": deviation_label(F.col("z_score"), s), "severity": severity(F.col("z_score"), s)})


def classify_plain(value: Column, mean: Column, std: Column) -> tuple[Column, Column]:
    """Dashboard variant: three-decimal z and a severity word, no streak; no usable deviation means z = 0."""
    z = F.when(std > 0, (value - mean) / std).otherwise(F.lit(0.0))
    size = F.abs(z)
    word = F.when(size >= 3, "significant").when(size >= 2, "moderate").when(size >= 1.5, "mild").otherwise("normal")
    return round_half_away(z, 3), word


# ---- sustained runs --------------------------------------------------------------------------------------------

def _streak_columns(dev: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    high = F.coalesce(F.abs(finite(F.col("z_score"))) > threshold, F.lit(False))
    return dev.withColumn("high", high).withColumn(
        "island", F.sum(F.when(F.col("high"), 0).otherwise(1)).over(by_date(keys).rowsBetween(W.unboundedPreceding, 0))
    )


def running_streak(dev: DataFrame, keys: list[str] = SERIES, threshold: float = fv.SUSTAINED_Z) -> DataFrame:
    """Length of the run of |z| > threshold that ends at each row; a null or small z resets it."""
    w = by_date(keys).rowsBetween(W.unboundedPreceding, 0)
    high = F.coalesce(F.abs(finite(F.col("z_score"))) > threshold, F.lit(False))
    out = dev.withColumn("_rn", F.row_number().over(by_date(keys)))
    last_reset = F.coalesce(F.max(F.when(~high, F.col("_rn"))).over(w), F.lit(0))
    return out.withColumn("streak", F.col("_rn") - last_reset).drop("_rn")


def current_streak(dev: DataFrame, keys: list[str] = SERIES, threshold: float = fv.SUSTAINED_Z, min_days: int = fv.SUSTAINED_DAYS) -> DataFrame:
    """Run length at the latest row of each series, folded over its (calendar-bounded) days from the newest back."""
    high = F.coalesce(F.abs(finite(F.col("z_score"))) > threshold, F.lit(False))
    dated = F.struct("date", high.alias("high"))
    per = dev.groupBy(*keys).agg(F.sort_array(F.collect_list(dated), asc=False).alias("days"))
    n = F.aggregate(
        "days",
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda s, d: F.struct(
            F.when(s["open"] & d["high"], s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & d["high"]).alias("open")
        ),
        lambda s: s["n"],
    )
    return per.select(*keys, n.alias("consecutive_days")).withColumn(
        "is_sustained", F.col("consecutive_days") >= min_days
    )


def sustained_runs(dev: DataFrame, keys: list[str] = SERIES, threshold: float = fv.SUSTAINED_Z, min_days: int = fv.SUSTAINED_DAYS) -> DataFrame:
    """All runs of at least ``min_days`` rows with their first and last date."""
    return (
        _streak_columns(dev, keys, threshold)
        .where("high")
        .groupBy(*keys, "island")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("duration_days"))
        .where(F.col("duration_days") >= min_days)
        .drop("island")
    )


def max_streak(dev: DataFrame, keys: list[str] = SERIES, threshold: float = fv.SUSTAINED_Z) -> DataFrame:
    return running_streak(dev, keys, threshold).groupBy(*keys).agg(F.max("streak").alias("max_streak"))


# ---- rolling statistics ----------------------------------------------------------------------------------------

def rolling7_columns(keys: list[str] = SERIES) -> dict[str, Column]:
    w = by_date(keys).rowsBetween(-6, 0)
    v, q = finite(F.col("value")), finite(F.col("quality_score"))
    n = F.count(v).over(w)
    return {
        "seven_day_average": F.when(n > 0, round4(exact_sum(v, w) / n)),
        "seven_day_variability": F.when(n == 1, F.lit(0.0)).when(n > 1, round4(F.stddev_samp(v).over(w))),
        "data_quality": F.coalesce(
            clamp(round4(exact_sum(q, w) / F.count(q).over(w)), 0, 1), F.lit(0.0)
        ),
    }


def slope14_column(keys: list[str] = SERIES) -> Column:
    """Least-squares slope of the last 14 rows against their position; null values keep their position.

    The slope does not change when positions are shifted, so the global row number serves as position (column
    ``rn``). All sums are independent of the order of rows.
    """
    w = by_date(keys).rowsBetween(-13, 0)
    v = finite(F.col("value"))
    x = F.when(v.isNotNull(), F.col("rn").cast("long"))
    n = F.count(v).over(w)
    sx, sy = F.sum(x).over(w), exact_sum(v, w)
    sxy, sxx = exact_sum(x * v, w), F.sum(x * x).over(w)
    den = n * sxx - sx * sx
    return F.when((n >= 2) & (den != 0), round4((n * sxy - sx * sy) / den)).otherwise(F.lit(0.0))


def missing14_column(keys: list[str] = SERIES) -> Column:
    n = F.count(finite(F.col("value"))).over(by_date(keys).rowsBetween(-13, 0))
    return round4((F.lit(14) - n) / F.lit(14.0))


def rolling7(hub: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return hub.withColumns(rolling7_columns(keys))


def slope14(hub: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    out = hub.withColumn("rn", F.row_number().over(by_date(keys)))
    return out.withColumn("fourteen_day_trend", slope14_column(keys)).drop("rn")


def missingness14(hub: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return hub.withColumn("missingness", missing14_column(keys))


def trend_label(slope: Column, value: Column, centre: Column, threshold: float = fv.SLOPE_THRESHOLD) -> Column:
    diff = F.coalesce(value, F.lit(0.0)) - F.coalesce(centre, value, F.lit(0.0))
    away = ((diff >= 0) & (slope > 0)) | ((diff < 0) & (slope < 0))
    toward = ((diff > 0) & (slope < 0)) | ((diff < 0) & (slope > 0))
    return (
        F.when(slope.isNull() | (F.abs(slope) < threshold), fv.TREND_STABLE)
        .when(away, fv.TREND_PROGRESSIVE)
        .when(toward, fv.TREND_IMPROVING)
        .otherwise(fv.TREND_STABLE)
    )


def densify(hub: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per calendar day between the first and last date of a series; added days carry null values."""
    span = hub.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = span.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    return spine.join(hub, [*keys, "date"], "left")


def longitudinal(hub: DataFrame, baseline: DataFrame, keys: list[str] = SERIES, carry: list[str] | None = None) -> DataFrame:
    """Composite trend row per (series, date): 7-row and 14-row statistics, deviation, run length (within the last 14
    rows), missingness and label, and the columns ``carry`` of the hub."""
    dev = deviation(hub, baseline).withColumn("rn", F.row_number().over(by_date(keys)))
    w = by_date(keys).rowsBetween(W.unboundedPreceding, 0)
    high = F.coalesce(F.abs(F.col("z_score")) > fv.SUSTAINED_Z, F.lit(False))
    reset = F.coalesce(F.max(F.when(~high, F.col("rn"))).over(w), F.lit(0))
    out = dev.withColumns(
        {
            **rolling7_columns(keys),
            "fourteen_day_trend": slope14_column(keys),
            "missingness": missing14_column(keys),
            "sustained_deviation": F.least(F.col("rn") - reset, F.lit(14)),
        }
    )
    centre = F.coalesce("baseline_mean", "baseline_median")
    return out.select(
        *keys,
        "date",
        round4(F.col("value")).alias("daily_value"),
        "seven_day_average",
        "seven_day_variability",
        "fourteen_day_trend",
        F.col("z_score").alias("baseline_deviation"),
        "sustained_deviation",
        "missingness",
        "data_quality",
        trend_label(F.col("fourteen_day_trend"), F.col("value"), centre).alias("trend_label"),
        *(carry or []),
    )


# ---- self-report concern ---------------------------------------------------------------------------------------

def reported_movement(df: DataFrame) -> Column:
    cond = F.lit(False)
    if "unusual_movement_self_report" in df.columns:
        cond = cond | F.coalesce(F.col("unusual_movement_self_report").cast("boolean"), F.lit(False))
    if "movement_response" in df.columns:
        cond = cond | F.coalesce(F.lower("movement_response") == "yes", F.lit(False))
    return cond


def concern_window(sleep: DataFrame, as_of, window_days: int = 7, threshold: int = 2) -> DataFrame:
    """Distinct days with a reported movement since ``as_of`` minus the window, and whether they reach the threshold."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {window_days} DAYS")
    day = F.to_date("timestamp")
    return (
        sleep.where(F.col("timestamp").cast("timestamp_ntz") >= cutoff)
        .groupBy("participant_id")
        .agg(
            F.count_distinct(F.when(reported_movement(sleep), day)).alias("positive_days"),
            F.count(F.lit(1)).alias("evaluated_sessions"),
        )
        .withColumn("flagged", F.col("positive_days") >= threshold)
    )


def rolling_concern(sleep: DataFrame, window_days: int = 7, threshold: int = 2) -> DataFrame:
    """The same count for every day with a report: days are made distinct first, then a range frame counts them."""
    per_day = sleep.groupBy("participant_id", F.to_date("timestamp").alias("date")).agg(
        F.max(reported_movement(sleep).cast("int")).alias("positive")
    )
    w = W.partitionBy("participant_id").orderBy(F.unix_date("date")).rangeBetween(-(window_days - 1), 0)
    return per_day.withColumn("positive_days", F.sum("positive").over(w)).withColumn(
        "flagged", F.col("positive_days") >= threshold
    )
