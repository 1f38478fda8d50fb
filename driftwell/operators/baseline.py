"""Personal baselines over the long feature table (*hub*).

The hub has one row per (participant, modality, feature, date), so a key's history is bounded by the calendar: ten
years are 3,653 rows.  The arrays built here per key therefore stay small however many sessions a day had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.functions.numeric import (
    clamp,
    exact_sum,
    finite,
    round4,
    round_half_away,
    sorted_median,
    sorted_quantile,
)

SERIES = ["participant_id", "modality", "feature_name"]


def feature_series(daily: DataFrame, min_quality: float = fv.MIN_QUALITY) -> DataFrame:
    """Daily vectors to the hub: one row per present, finite feature of a modality of sufficient quality.

    A modality without its own quality (sleep) counts as 1.0. Narrow: no shuffle.
    """
    has_quality = {m: m in fv.QUALITY_TRACKED for m in fv.MODALITIES}
    rows = [
        F.struct(
            F.lit(m).alias("modality"),
            F.lit(n).alias("feature_name"),
            finite(F.col(m)[n]).alias("value"),
            (F.coalesce(F.col(f"quality.{m}_quality"), F.lit(1.0)) if has_quality[m] else F.lit(1.0)).alias("quality_score"),
        )
        for m in fv.MODALITIES
        for n in fv.MODALITY_FEATURES[m]
    ]
    usable = F.filter(F.array(*rows), lambda r: r["value"].isNotNull() & (r["quality_score"] >= min_quality))
    return daily.select("participant_id", "date", F.inline(usable))


def _collected(hub: DataFrame, keys: list[str]) -> DataFrame:
    v = finite(F.col("value"))
    return hub.groupBy(*keys).agg(
        F.sort_array(F.collect_list(v)).alias("arr"),
        exact_sum(v).alias("sum"),
        F.stddev_samp(finite(F.col("value"))).alias("sd"),
        F.min("date").alias("baseline_start_date"),
        F.max("date").alias("baseline_end_date"),
    )


def baseline_stats(hub: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Mean, median, sample deviation, quartiles, IQR, unscaled MAD and CV per key: one shuffle.

    MAD is taken about the rounded median and CV from the rounded mean and deviation.
    """
    g = _collected(hub, keys)
    n = F.size("arr")
    some = n > 0
    g = g.withColumns(
        {
            "sample_count": n,
            "baseline_mean": F.when(some, round4(F.col("sum") / n)),
            "baseline_median": F.when(some, round4(sorted_median(F.col("arr")))),
            "baseline_std": F.when(some, round4(F.coalesce(F.col("sd"), F.lit(0.0)))),
            "q1": F.when(some, round4(sorted_quantile(F.col("arr"), 0.25))),
            "q3": F.when(some, round4(sorted_quantile(F.col("arr"), 0.75))),
        }
    )
    centre = F.col("baseline_median")
    spread = F.sort_array(F.transform("arr", lambda v: F.abs(v - centre)))
    return g.withColumns(
        {
            "baseline_mad": F.when(some, round4(sorted_median(spread))),
            "iqr": round4(F.col("q3") - F.col("q1")),
            "coefficient_of_variation": F.when(
                F.col("baseline_mean") != 0, round4(F.abs(F.col("baseline_std") / F.col("baseline_mean")))
            ).when(some, F.lit(0.0)),
        }
    ).drop("arr", "sum", "sd")


def mad(hub: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return baseline_stats(hub, keys).select(*keys, "baseline_mad")


def dispersion_unit(mad_col: Column, std_col: Column) -> Column:
    """Width for bounds: MAD, else the deviation, else a small constant."""
    return F.when(mad_col > 0, mad_col).when(std_col > 0, std_col).otherwise(F.lit(fv.MIN_DISPERSION))


def effective_dispersion(mad_col: Column, std_col: Column) -> Column:
    """Width for outlier distances: MAD, else the deviation scaled to MAD, else a small constant."""
    return (
        F.when(mad_col > 0, mad_col)
        .when(std_col > 0, round4(std_col * F.lit(fv.STD_TO_MAD)))
        .otherwise(F.lit(fv.MIN_DISPERSION))
    )


def baseline_row(hub: DataFrame, keys: list[str] = SERIES, min_days: int = fv.MIN_BASELINE_DAYS) -> DataFrame:
    stats = baseline_stats(hub, keys)
    unit = dispersion_unit(F.col("baseline_mad"), F.col("baseline_std"))
    return stats.withColumns(
        {
            "lower_bound": round4(F.col("baseline_median") - 3.0 * unit),
            "upper_bound": round4(F.col("baseline_median") + 3.0 * unit),
            "baseline_status": F.when(F.col("sample_count") == 0, "insufficient_data")
            .when(F.col("sample_count") >= min_days, "established")
            .otherwise("calibrating"),
            "baseline_version": F.lit("1.0.0"),
            "algorithm_version": F.lit("1.0.0"),
        }
    )


def in_period(hub: DataFrame, start=None, end=None) -> DataFrame:
    """Calibration rows; the date bounds reach the scan as partition or Parquet filters."""
    if start is not None:
        hub = hub.where(F.col("date") >= F.lit(start))
    if end is not None:
        hub = hub.where(F.col("date") <= F.lit(end))
    return hub


def establish(hub: DataFrame, start=None, end=None, min_days: int = fv.MIN_BASELINE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Baseline rows and the per-participant summary."""
    rows = baseline_row(in_period(hub, start, end), min_days=min_days)
    return rows, baseline_summary(rows)


def baseline_summary(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("participant_id")
        .agg(
            F.count(F.lit(1)).alias("total_features"),
            F.count_if(F.col("baseline_status") == "established").alias("established_features"),
        )
        .withColumn(
            "overall_status",
            F.when(
                (F.col("established_features") > 0) & (F.col("established_features") == F.col("total_features")),
                "established",
            )
            .when(F.col("total_features") > 0, "calibrating")
            .otherwise("no_data"),
        )
    )


# ---- outliers and deviation records ----------------------------------------------------------------------------

BASELINE_COLUMNS = ["baseline_mean", "baseline_median", "baseline_std", "baseline_mad"]


def with_baseline(obs: DataFrame, baseline: DataFrame, how: str = "left", keys: list[str] = SERIES) -> DataFrame:
    """Equi-join on the series key; AQE chooses the strategy from the measured size and splits a skewed side."""
    return obs.join(baseline.select(*keys, *BASELINE_COLUMNS), keys, how)


def outlier_columns(value: Column, median: Column, mad_col: Column, std_col: Column, threshold: float = fv.OUTLIER_MAD) -> dict[str, Column]:
    distance = F.when(
        finite(value).isNotNull() & median.isNotNull(),
        round4(F.abs(value - median) / effective_dispersion(mad_col, std_col)),
    )
    flagged = F.coalesce(distance > threshold, F.lit(False))
    return {
        "mad_distance": distance,
        "is_outlier": flagged,
        "anomaly_flag": F.when(flagged, "anomalous observation"),
    }


def detect_outliers(obs: DataFrame, baseline: DataFrame, threshold: float = fv.OUTLIER_MAD, how: str = "left") -> DataFrame:
    joined = with_baseline(obs, baseline, how)
    return joined.withColumns(
        outlier_columns(
            F.col("value"), F.col("baseline_median"), F.col("baseline_mad"), F.col("baseline_std"), threshold
        )
    )


def robust_deviation(obs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Deviation in MAD-scaled units, signed distance from the median, and the outlier verdict."""
    return _deviation_records(detect_outliers(obs, baseline))


def _deviation_records(judged: DataFrame) -> DataFrame:
    """One record per row of ``detect_outliers``."""
    median = F.coalesce(F.col("baseline_median"), F.col("value"))
    width = effective_dispersion(F.col("baseline_mad"), F.col("baseline_std"))
    return judged.select(
        *SERIES,
        "date",
        round4(F.col("value")).alias("value"),
        round4(median).alias("baseline_value"),
        round4((F.col("value") - median) / (width * F.lit(fv.MAD_TO_STD))).alias("deviation_score"),
        round4(F.col("value") - median).alias("trend_score"),
        round4(clamp(F.coalesce(F.col("quality_score"), F.lit(1.0)), 0, 1)).alias("quality_score"),
        "is_outlier",
        "anomaly_flag",
        "mad_distance",
        F.when(
            F.col("is_outlier"),
            "Recent measurement differs notably from personal baseline (anomalous observation).",
        )
        .otherwise("Measurement consistent with personal baseline.")
        .alias("summary_text"),
    )


# ---- adaptive baseline -----------------------------------------------------------------------------------------

def ewma_step(state: Column, value: Column, alpha: float) -> Column:
    """Next {mean, median, std, mad, n} after an accepted value; every field rounded to four decimals."""
    keep = 1.0 - alpha
    mean = round4(F.lit(alpha) * value + F.lit(keep) * state["mean"])
    median = round4(F.lit(alpha) * value + F.lit(keep) * state["median"])
    var = F.lit(alpha) * (value - mean) * (value - mean) + F.lit(keep) * state["std"] * state["std"]
    mad_next = round4(F.lit(alpha) * F.abs(value - median) + F.lit(keep) * state["mad"])
    return F.struct(
        mean.alias("mean"),
        median.alias("median"),
        round4(F.sqrt(var)).alias("std"),
        mad_next.alias("mad"),
        (state["n"] + 1).alias("n"),
        state["low_quality"].alias("low_quality"),
        state["outliers"].alias("outliers"),
    )


def _counted(state: Column, low: int, out: int) -> Column:
    return F.struct(
        *[state[f].alias(f) for f in ("mean", "median", "std", "mad", "n")],
        (state["low_quality"] + low).alias("low_quality"),
        (state["outliers"] + out).alias("outliers"),
    )


def adaptive_baseline(
    obs: DataFrame,
    baseline: DataFrame,
    alpha: float = fv.EWMA_ALPHA,
    min_quality: float = fv.MIN_QUALITY,
    threshold: float = fv.OUTLIER_MAD,
) -> DataFrame:
    """Folds each series' later days into its baseline in date order, skipping poor and outlying days.

    Acceptance depends on the state left by the previous day, so this is a JVM-side ``aggregate`` over the (calendar-
    bounded) array of the series rather than a window function.  A series without later days keeps its state, with 0 updates.
    """
    days = obs.where(finite(F.col("value")).isNotNull()).groupBy(*SERIES).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("date"), finite(F.col("value")).alias("v"), F.coalesce(F.col("quality_score"), F.lit(1.0)).alias("q"))
            )
        ).alias("days")
    )
    start = F.struct(
        F.col("baseline_mean").alias("mean"),
        F.col("baseline_median").alias("median"),
        F.col("baseline_std").alias("std"),
        F.col("baseline_mad").alias("mad"),
        F.col("sample_count").cast("long").alias("n"),
        F.lit(0).cast("long").alias("low_quality"),
        F.lit(0).cast("long").alias("outliers"),
    )

    def step(state: Column, day: Column) -> Column:
        distance = round4(F.abs(day["v"] - state["median"]) / effective_dispersion(state["mad"], state["std"]))
        return (
            F.when(day["q"] < min_quality, _counted(state, 1, 0))
            .when(distance > threshold, _counted(state, 0, 1))
            .otherwise(ewma_step(state, day["v"], alpha))
        )

    base = baseline.where("sample_count > 0").select(*SERIES, *BASELINE_COLUMNS, "sample_count", "baseline_version")
    folded = base.join(days, SERIES, "left").withColumn("s", F.coalesce(F.aggregate("days", start, step), start))
    return finish_adaptive(folded.withColumn("updates", F.col("s.n") - F.col("sample_count")))


def finish_adaptive(folded: DataFrame) -> DataFrame:
    s = {f: F.col(f"s.{f}") for f in ("mean", "median", "std", "mad", "n", "low_quality", "outliers")}
    unit = dispersion_unit(s["mad"], s["std"])
    return folded.select(
        *SERIES,
        s["mean"].alias("baseline_mean"),
        s["median"].alias("baseline_median"),
        s["std"].alias("baseline_std"),
        s["mad"].alias("baseline_mad"),
        round4(s["median"] - F.lit(fv.STD_TO_MAD) * unit).alias("q1"),
        round4(s["median"] + F.lit(fv.STD_TO_MAD) * unit).alias("q3"),
        F.when(s["mean"] != 0, round4(F.abs(s["std"] / s["mean"]))).otherwise(F.lit(0.0)).alias("coefficient_of_variation"),
        round4(s["median"] - 3.0 * unit).alias("lower_bound"),
        round4(s["median"] + 3.0 * unit).alias("upper_bound"),
        bump_patch(F.col("baseline_version"), F.col("updates")).alias("baseline_version"),
        s["n"].alias("sample_count"),
        s["low_quality"].alias("rejected_low_quality"),
        s["outliers"].alias("rejected_outlier"),
    )


def bump_patch(version: Column, by: Column | int = 1) -> Column:
    """major.minor.patch with the patch raised; an absent or unreadable part falls back to 1, 0, 0."""
    parts = F.split(version, r"\.")

    def part(i: int, default: int) -> Column:
        digits = F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^\s*(-?\d+)", 1)
        return F.coalesce(digits.try_cast("bigint"), F.lit(default).cast("bigint"))

    step = F.lit(by) if isinstance(by, int) else by
    return F.concat_ws(".", part(0, 1).cast("string"), part(1, 0).cast("string"), (part(2, 0) + step).cast("string"))


def baseline_version(current: DataFrame, increment: int = 1) -> DataFrame:
    """Next version metadata of each baseline row; the creation time is kept."""
    return current.withColumns(
        {
            "baseline_version": bump_patch(F.coalesce(F.col("baseline_version"), F.lit("1.0.0"))),
            "sample_count": F.coalesce(F.col("sample_count"), F.lit(fv.MIN_BASELINE_DAYS)) + increment,
            "algorithm_version": F.coalesce(F.col("algorithm_version"), F.lit("1.0.0")),
        }
    )


def process_day(
    day: DataFrame,
    baseline: DataFrame,
    alpha: float = fv.EWMA_ALPHA,
    min_quality: float = fv.MIN_QUALITY,
    threshold: float = fv.OUTLIER_MAD,
) -> DataFrame:
    """Verdict, its reason and the next baseline values of every feature measured on one day.

    Features without a baseline are skipped.  Every column of ``baseline`` is carried, so that ``updated_baselines`` and
    ``day_deviations`` need no second join; columns of ``day`` with the same names go.  A null quality counts as 1.0.
    """
    day = day.drop(*[c for c in baseline.columns if c not in SERIES])
    rows = day.where(finite(F.col("value")).isNotNull()).join(baseline, SERIES, "inner")
    rows = rows.withColumns(
        outlier_columns(F.col("value"), F.col("baseline_median"), F.col("baseline_mad"), F.col("baseline_std"), threshold)
    )
    q = F.coalesce(F.col("quality_score"), F.lit(1.0))
    state = F.struct(
        F.col("baseline_mean").alias("mean"),
        F.col("baseline_median").alias("median"),
        F.col("baseline_std").alias("std"),
        F.col("baseline_mad").alias("mad"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("low_quality"),
        F.lit(0).cast("long").alias("outliers"),
    )
    status = F.when(q < min_quality, "rejected_low_quality").when(F.col("is_outlier"), "rejected_outlier").otherwise("updated")
    reason = (
        F.when(
            F.col("status") == "rejected_low_quality",
            F.format_string(f"Quality score %.2f is below minimum threshold {min_quality:.2f}", q),
        )
        .when(
            F.col("status") == "rejected_outlier",
            F.format_string(f"Observation deviates by %.4f MAD (> {threshold:g} threshold) from personal baseline", F.col("mad_distance")),
        )
        .otherwise(f"Baseline updated using EWMA (alpha = {alpha:g}) with new observation")
    )
    out = rows.withColumn("status", status).withColumns({"reason": reason, "_next": ewma_step(state, F.col("value"), alpha)})
    updated = F.col("status") == "updated"
    for name in ("mean", "median", "std", "mad"):
        out = out.withColumn(f"new_{name}", F.when(updated, F.col(f"_next.{name}")).otherwise(F.col(f"baseline_{name}")))
    return out.drop("_next")


def updated_baselines(processed: DataFrame) -> DataFrame:
    """The whole baseline row of every feature judged by ``process_day``: moved where accepted, else kept as it was.

    An accepted day sets statistics, bounds, status, version and sample count anew; IQR, algorithm version and calibration
    period stay.  ``baseline_updated_at`` is the day that moved the row, not the time of the run, so reruns agree; null
    where the row was kept.
    """
    updated = F.col("status") == "updated"
    mean, median, std, mad_next = (F.col(f"new_{c}") for c in ("mean", "median", "std", "mad"))
    unit = dispersion_unit(mad_next, std)

    def moved(name: str, value: Column) -> Column:
        return F.when(updated, value).otherwise(F.col(name)).alias(name)

    return processed.select(
        *SERIES,
        *[F.col(f"new_{c}").alias(f"baseline_{c}") for c in ("mean", "median", "std", "mad")],
        moved("q1", round4(median - F.lit(fv.STD_TO_MAD) * unit)),
        moved("q3", round4(median + F.lit(fv.STD_TO_MAD) * unit)),
        "iqr",
        moved("coefficient_of_variation", F.when(mean != 0, round4(F.abs(std / mean))).otherwise(F.lit(0.0))),
        moved("lower_bound", round4(median - 3.0 * unit)),
        moved("upper_bound", round4(median + 3.0 * unit)),
        moved("baseline_status", F.lit("adaptive_updated")),
        moved("baseline_version", bump_patch(F.coalesce(F.col("baseline_version"), F.lit("1.0.0")))),
        moved("sample_count", F.coalesce(F.col("sample_count"), F.lit(fv.MIN_BASELINE_DAYS)) + 1),
        "algorithm_version",
        "baseline_start_date",
        "baseline_end_date",
        F.when(updated, F.col("date")).alias("baseline_updated_at"),
    )


def day_deviations(processed: DataFrame) -> DataFrame:
    """Deviation records of a day against the baselines it met; days of poor quality give none."""
    return _deviation_records(processed.where("status <> 'rejected_low_quality'"))


def day_counters(processed: DataFrame) -> DataFrame:
    return processed.groupBy("participant_id", "date").agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        F.count_if(F.col("status") == "updated").alias("updated_count"),
        F.count_if(F.col("status") == "rejected_outlier").alias("rejected_outlier_count"),
        F.max(F.col("status") == "rejected_outlier").alias("has_anomalies"),
    )


def deviation_distance(obs: DataFrame, baseline: DataFrame, significant: float = 2.0) -> DataFrame:
    """Per participant and day: root mean square of the z-scores and the features with |z| >= 2.

    Features whose baseline deviation is zero or absent do not count. The list per day is bounded by the number of
    features a vector can hold.
    """
    usable = F.col("baseline_std") > 0
    z = F.when(usable, (F.col("value") - F.col("baseline_mean")) / F.col("baseline_std"))
    name = F.concat_ws(".", "modality", "feature_name")
    return (
        with_baseline(obs, baseline, "inner")
        .withColumn("z", z)
        .groupBy("participant_id", "date")
        .agg(
            F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)).alias("sq"),
            F.count("z").alias("k"),
            F.sort_array(F.collect_list(F.when(F.abs(F.col("z")) >= significant, name))).alias("significant_deviations"),
        )
        .withColumn("distance", round_half_away(F.sqrt(F.col("sq") / F.greatest(F.col("k"), F.lit(1))), 3))
        .withColumn("is_significant", F.size("significant_deviations") > 0)
        .drop("sq")
    )
