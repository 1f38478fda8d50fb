"""Quality gating, missingness and the per-participant daily roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.functions.numeric import clamp, exact_sum, finite, first_present, round4, round_half_away
from driftwell.operators import orderstats as osx

DAY = ["participant_id", "date"]


# ---- quality gate ----------------------------------------------------------------------------------------------

def session_quality(df: DataFrame) -> Column:
    """Quality in [0, 1]: the quality score, else the score (percent if above 1), else the signal quality, else 0."""
    raw = _raw_quality(df)
    return clamp(F.coalesce(raw, F.lit(0.0)), 0, 1)


def _raw_quality(df: DataFrame) -> Column:
    def number(name: str) -> Column:
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if name in df.columns else F.lit(None).cast("double")

    score = number("score")
    return F.coalesce(
        number("quality_score"), F.when(score > 1, score / 100.0).otherwise(score), number("signal_quality")
    )


def passes_quality(df: DataFrame, threshold: float = fv.MIN_QUALITY) -> Column:
    raw = _raw_quality(df)
    return F.coalesce((raw >= 0) & (raw >= threshold), F.lit(False))


def _rejection_reason(quality: Column, threshold: float) -> Column:
    return F.concat(
        F.lit("Quality score "),
        F.format_string("%.3f", quality),
        F.lit(f" is below minimum threshold {threshold:g}"),
    )


def quality_gate(df: DataFrame, threshold: float = fv.MIN_QUALITY) -> DataFrame:
    """Every session with ``accepted`` and, for a rejected one, the reason. Narrow: no shuffle."""
    q = session_quality(df)
    reason = _rejection_reason(q, threshold)
    return df.withColumns(
        {
            "accepted": passes_quality(df, threshold),
            "effective_quality": q,
        }
    ).withColumn("rejection_reason", F.when(~F.col("accepted"), reason))


def modality_status(sessions: DataFrame, threshold: float = fv.MIN_QUALITY) -> DataFrame:
    """valid / low_quality per (participant, day, modality) with the median quality of the accepted sessions.

    If none was accepted the median is that of all sessions. A modality without rows has status missing; it has no
    row here (see ``modality_report`` and ``missingness_tracker``).
    """
    return _status(_quality_counts(sessions, threshold))


def _quality_counts(sessions: DataFrame, threshold: float) -> DataFrame:
    return osx.value_counts(quality_gate(sessions, threshold), [*DAY, "modality", "accepted"], F.col("effective_quality"))


def _status(counts: DataFrame) -> DataFrame:
    keys = [*DAY, "modality"]
    per_flag = osx.ranked(counts, [*keys, "accepted"]).groupBy(*keys, "accepted").agg(
        F.max("n").alias("n"), osx.median_expr().alias("median_value")
    )
    ok = F.col("accepted")
    return (
        per_flag.groupBy(*keys)
        .agg(
            F.max(F.when(ok, F.col("median_value"))).alias("ok_median"),
            F.max(F.when(~ok, F.col("median_value"))).alias("low_median"),
            F.coalesce(F.max(F.when(ok, F.col("n"))), F.lit(0)).cast("long").alias("passed_count"),
            F.sum("n").alias("total_count"),
        )
        .select(
            *keys,
            F.when(F.col("passed_count") > 0, "valid").otherwise("low_quality").alias("status"),
            round4(F.coalesce("ok_median", "low_median")).alias("quality_score"),
            "passed_count",
            "total_count",
            (F.col("total_count") - F.col("passed_count")).alias("rejected_count"),
        )
    )


NO_SESSIONS = "No sessions recorded for modality on this day."


def modality_report(sessions: DataFrame, threshold: float = fv.MIN_QUALITY, modalities: list[str] | None = None) -> DataFrame:
    """``modality_status`` with a row for every expected modality of a day and ``reasons``.

    A participant's day counts if it has a session of any modality; its modalities without one are ``missing``.  A low-quality
    modality lists the distinct rejection reasons with their number of sessions, at most one per thousandth below the
    threshold however many sessions the day had; a valid one lists none.  Sessions without a quality count as 0, modalities
    outside the expected ones keep their rows, and no sessions give no rows.
    """
    keys = [*DAY, "modality"]
    counts = _quality_counts(sessions, threshold)
    rejected = counts.where(~F.col("accepted")).groupBy(*keys, _rejection_reason(F.col("v"), threshold).alias("reason")).agg(F.sum("c").alias("sessions"))
    reasons = rejected.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("reason", "sessions"))).alias("found"))
    none = F.array().cast("array<struct<reason:string,sessions:bigint>>")
    low = F.when(F.col("status") == "low_quality", F.col("found"))
    status = _status(counts).join(reasons, keys, "left").withColumn("reasons", F.coalesce(low, none)).drop("found")
    values = [c for c in status.columns if c not in DAY]
    days = status.groupBy(*DAY).agg(F.collect_list(F.struct(*values)).alias("rows"))
    expected = F.array(*[F.lit(m) for m in modalities or fv.MODALITIES])
    zero = F.lit(0).cast("long")

    def missing(modality: Column) -> Column:
        why = F.array(F.struct(F.lit(NO_SESSIONS).alias("reason"), zero.alias("sessions")))
        fixed = {"modality": modality, "status": F.lit("missing"), "quality_score": F.lit(None).cast("double"), "reasons": why}
        return F.struct(*[fixed.get(c, zero).alias(c) for c in values])

    absent = F.transform(F.array_except(expected, F.col("rows.modality")), missing)
    return days.select(*DAY, F.inline(F.concat("rows", absent)))


def _day_flags(status: DataFrame) -> DataFrame:
    """One row per (participant, day) with the status and quality of each modality side by side."""
    modality = F.col("modality")
    return status.groupBy(*DAY).agg(
        *[F.max(F.when(modality == m, F.col("status"))).alias(f"_{m}") for m in fv.MODALITIES],
        *[F.max(F.when(modality == m, F.col("quality_score"))).alias(f"{m}_quality") for m in fv.QUALITY_TRACKED],
    )


def _availability() -> list[Column]:
    def listed(name: str, cond) -> Column:
        return F.array_compact(F.array(*[F.when(cond(F.col(f"_{m}")), F.lit(m)) for m in fv.MODALITIES])).alias(name)

    ok = sum((F.when(F.col(f"_{m}") == "valid", 1).otherwise(0) for m in fv.MODALITIES[1:]), F.when(F.col(f"_{fv.MODALITIES[0]}") == "valid", 1).otherwise(0))
    return [
        listed("available_modalities", lambda s: s == "valid"),
        listed("missing_modalities", lambda s: s.isNull() | (s != "valid")),
        listed("low_quality_modalities", lambda s: s == "low_quality"),
        round_half_away(ok / F.lit(float(len(fv.MODALITIES))), 2).alias("completeness_ratio"),
    ]


def missingness_tracker(status: DataFrame) -> DataFrame:
    """Available, missing and low-quality modality arrays per day, in the fixed modality order."""
    return _day_flags(status).select(*DAY, *_availability())


def overall_quality_expr(columns: list[Column]) -> Column:
    """Mean of the present modality qualities (sleep is not among them), 0 if none is present."""
    present = [F.when(c >= 0, c) for c in columns]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in present])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in present])
    return F.when(n > 0, round4(total / n)).otherwise(F.lit(0.0))


def _qualities() -> list[Column]:
    q = [F.col(f"{m}_quality") for m in fv.QUALITY_TRACKED]
    return [*q, overall_quality_expr(q).alias("overall_quality")]


def overall_quality(status: DataFrame) -> DataFrame:
    return _day_flags(status).select(*DAY, *_qualities())


# ---- per-feature statistics ------------------------------------------------------------------------------------

def hinge_iqr_expr(n: Column, q1_value: Column, q3_value: Column, min_value: Column, max_value: Column) -> Column:
    """IQR between hinges rounded to four decimals; the range for two values, 0 for fewer."""
    spread = round4(F.greatest(round4(q3_value) - round4(q1_value), F.lit(0.0)))
    return F.when(n < 2, F.lit(0.0)).when(n == 2, round4(max_value - min_value)).otherwise(spread)


def _finish_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    mean = F.col("sum") / F.col("n")
    std = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return (
        df.withColumns({"mean": mean, "std": std})
        .withColumn("cv", F.when((F.col("mean") != 0) & (F.col("n") > 1), F.abs(F.col("std") / F.col("mean"))).otherwise(F.lit(0.0)))
        .select(
            *keys,
            "n",
            round4(F.col("median_value")).alias("median"),
            hinge_iqr_expr(*[F.col(c) for c in ("n", "q1_value", "q3_value", "min_value", "max_value")]).alias("iqr"),
            "mean",
            "std",
            "cv",
            "min_value",
            "max_value",
        )
    )


def day_statistics(long: DataFrame, keys: list[str]) -> DataFrame:
    """Median, hinge IQR, mean, sample deviation and variation per group of ``value``.

    The deviation is taken about the group mean inside the window that ranks the values, so one pass serves all.
    """
    ranked = osx.ranked(osx.value_counts(long, keys, F.col("value")), keys)
    centred = F.col("v") - F.col("sum") / F.col("n")
    q1, q3 = osx.hinge_quartiles()
    stats = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        osx.median_expr().alias("median_value"),
        q1.alias("q1_value"),
        q3.alias("q3_value"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
        F.max("sum").alias("sum"),
        F.sum(F.col("c") * centred * centred).alias("m2"),
    )
    return _finish_statistics(stats, keys)


def disagreement(stats: DataFrame) -> DataFrame:
    """Flags groups whose sessions disagree: high CV, high relative IQR, or two sessions far apart."""
    iqr_rel = F.when(F.coalesce(F.col("median"), F.lit(0.0)) != 0, F.abs(F.col("iqr") / F.col("median"))).otherwise(F.lit(0.0))
    range_rel = F.when(
        F.col("mean") != 0, (F.col("max_value") - F.col("min_value")) / F.abs(F.col("mean"))
    ).otherwise(F.lit(0.0))
    out = stats.withColumns({"iqr_relative": iqr_rel, "range_relative": range_rel})
    flagged = (F.col("n") >= 2) & (
        (F.col("cv") > fv.DISAGREE_CV)
        | (F.col("iqr_relative") > fv.DISAGREE_IQR_REL)
        | ((F.col("n") == 2) & (F.col("range_relative") > fv.DISAGREE_RANGE_REL))
    )
    reason = F.concat(
        F.lit("Significant session disagreement in "),
        F.col("feature_name") if "feature_name" in stats.columns else F.lit("feature"),
        F.format_string(": CV=%.2f, relative IQR=%.2f", F.col("cv"), F.col("iqr_relative")),
    )
    out = out.withColumn("disagree", flagged).withColumn("reason", F.when(F.col("disagree"), reason))
    return out.withColumns({"cv": round4(F.col("cv")), "iqr_relative": round4(F.col("iqr_relative"))})


def daily_medians(long: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Four-decimal median of several columns per group, plus the row count.

    The columns are melted, so all of them share one pair of shuffles.
    """
    melted = long.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in columns])),
    )
    by = [*keys, "_col"]
    med = osx.ranked(osx.value_counts(melted, by, F.col("_val")), by).groupBy(*by).agg(
        osx.median_expr().alias("m"), F.max("n").alias("n")
    )
    return med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_col") == c, round4(F.col("m")))).alias(c) for c in columns],
        F.max("n").alias("n_sessions"),
    )


# ---- modality roll-ups and day assembly ------------------------------------------------------------------------

def sessions_long(sessions: DataFrame, modalities: list[str] | None = None) -> DataFrame:
    """One row per (session, feature) of the accepted sessions; an absent feature gives no row."""
    cols = sessions.columns

    def features(m: str) -> Column:
        return F.array(
            *[
                F.struct(F.lit(name).alias("feature_name"), first_present(cols, aliases).alias("value"))
                for name, aliases in fv.MODALITY_FEATURES[m].items()
            ]
        )

    # Only the features of the row's own modality are built.
    own = F.coalesce(*[F.when(F.col("modality") == m, features(m)) for m in modalities or fv.MODALITIES])
    gated = sessions.where(passes_quality(sessions))
    return gated.select(*DAY, "modality", F.inline(own)).where(F.col("value").isNotNull())


def rollup(sessions: DataFrame, modality: str) -> DataFrame:
    """Median and hinge IQR of every feature of one modality per day, plus the accepted-session count."""
    scoped = sessions.where(F.col("modality") == modality)
    long = sessions_long(scoped, [modality])
    keys = [*DAY, "modality", "feature_name"]
    stats = disagreement(day_statistics(long, keys))
    watched = [n for n in fv.MODALITY_FEATURES[modality] if n in fv.DISAGREEMENT_NAMES]
    feature = F.col("feature_name")
    wide = stats.groupBy(*DAY).agg(
        *[F.max(F.when(feature == n, F.col("median"))).alias(n) for n in fv.MODALITY_FEATURES[modality]],
        *[F.max(F.when(feature == n, F.col("iqr"))).alias(f"{n}_iqr") for n in fv.MODALITY_FEATURES[modality]],
        F.count_if(feature.isin(watched) & F.col("disagree")).alias("disagreements"),
    )
    status = modality_status(scoped).where("status = 'valid'")
    return wide.join(
        status.select(*DAY, F.col("quality_score"), F.col("passed_count").alias("session_count")), DAY, "right"
    )


def aggregate_day(sessions: DataFrame) -> DataFrame:
    """All five modalities of a day: feature medians and IQRs, disagreement records, qualities and the availability arrays.

    One shuffle key family: statistics are computed long, then a conditional aggregate on (participant, date)
    assembles the day; there is no join per modality.  ``disagreements`` holds at most one record per watched feature, in
    the fixed feature order.
    """
    stats = disagreement(day_statistics(sessions_long(sessions), [*DAY, "modality", "feature_name"]))
    feature, modality = F.col("feature_name"), F.col("modality")
    named = [(m, n) for m in fv.MODALITIES for n in fv.MODALITY_FEATURES[m]]

    def of(m: str, n: str, value: Column) -> Column:
        return F.max(F.when((modality == m) & (feature == n), value))

    medians = [of(m, n, F.col("median")).alias(f"{m}__{n}") for m, n in named]
    iqrs = [of(m, n, F.col("iqr")).alias(f"{m}__{n}_iqr") for m, n in named]
    watched = feature.isin(list(fv.DISAGREEMENT_NAMES)) & F.col("disagree")
    records = [
        of(m, n, F.when(F.col("disagree"), _disagreement_record(m, fv.DISAGREEMENT_NAMES[n]))) for m, n in named if n in fv.DISAGREEMENT_NAMES
    ]
    features = stats.groupBy(*DAY).agg(
        *medians, F.count_if(watched).alias("disagreement_count"), *iqrs, F.array_compact(F.array(*records)).alias("disagreements")
    )
    days = _day_flags(modality_status(sessions)).select(*DAY, *_availability(), *_qualities())
    days = days.join(features, DAY, "left").fillna(0, ["disagreement_count"])
    return days.withColumn("disagreements", F.coalesce("disagreements", F.array().cast(days.schema["disagreements"].dataType)))


def _disagreement_record(modality: str, name: str) -> Column:
    """Modality, report name of the feature, number of sessions, dispersion and reason of a flagged row of ``disagreement``."""
    reason = F.regexp_replace("reason", r" in [^:]*:", f" in {name}:")
    return F.struct(F.lit(modality).alias("modality"), F.lit(name).alias("feature"), F.col("n").alias("session_count"), "cv", "iqr", "iqr_relative", reason.alias("reason"))


def daily_vector(sessions: DataFrame, version: str = fv.FEATURE_VERSION) -> DataFrame:
    """Nested daily vector: one nullable struct per modality and for its IQRs, a quality struct, availability arrays, a version, disagreement records."""
    day = aggregate_day(sessions)

    def block(m: str, suffix: str = "") -> Column:
        return F.when(
            F.array_contains("available_modalities", m),
            F.struct(*[F.col(f"{m}__{n}{suffix}").alias(n) for n in fv.MODALITY_FEATURES[m]]),
        ).alias(m)

    blocks = [block(m) for m in fv.MODALITIES]
    iqr = F.struct(*[block(m, "_iqr") for m in fv.MODALITIES]).alias("iqr")
    quality = F.struct(*[f"{m}_quality" for m in fv.QUALITY_TRACKED], "overall_quality").alias("quality")
    return day.select(
        *DAY,
        *blocks,
        quality,
        F.lit(version).alias("feature_version"),
        "available_modalities",
        "missing_modalities",
        "low_quality_modalities",
        "disagreement_count",
        iqr,
        "disagreements",
    )


# ---- participant roll-ups --------------------------------------------------------------------------------------

def participant_rollup(
    df: DataFrame, key: str, features: list[str], label: str | None = None, strategy: str = "mean"
) -> DataFrame:
    """Repeated recordings to one row per participant: mean or median per feature, most frequent label.

    Ties of the label go to the smallest one.
    """
    if strategy == "mean":
        out = df.groupBy(key).agg(*[(exact_sum(finite(F.col(f))) / F.count(finite(F.col(f)))).alias(f) for f in features])
    else:
        entries = [F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("value")) for f in features]
        long = df.select(key, F.inline(F.array(*entries)))
        ranked = osx.ranked(osx.value_counts(long, [key, "f"], F.col("value")), [key, "f"])
        medians = ranked.groupBy(key, "f").agg(osx.median_expr().alias("median"))
        out = medians.groupBy(key).agg(*[F.max(F.when(F.col("f") == f, F.col("median"))).alias(f) for f in features])
    if label is None:
        return out
    votes = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("votes"))
    modal = votes.groupBy(key).agg(F.min_by(F.col(label), F.struct(-F.col("votes"), F.col(label))).alias(label))
    return out.join(modal, key, "left")


def binarize_at_median(df: DataFrame, train: DataFrame, column: str, out: str = "label") -> DataFrame:
    """1 where the value is strictly above the exact median of the training rows.

    The median is a fitted parameter: one number, read once.
    """
    cutoff = osx.global_median(train, F.col(column)).first()["median"]
    above = F.col(column).cast("double") > F.lit(cutoff)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), above.cast("int")))
