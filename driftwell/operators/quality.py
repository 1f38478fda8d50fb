"""Data-quality reports. Each returns a report DataFrame; ``enforce`` turns a non-empty report into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.functions.numeric import finite, reasons, round4
from driftwell.operators import orderstats as osx


class IntegrityError(ValueError):
    """A strict check found offending rows."""


def enforce(report: DataFrame, message: str, where: Column | str | None = None) -> None:
    """Raises when the report has a row; reads at most one."""
    offending = report if where is None else report.where(where)
    first = offending.take(1)
    if first:
        raise IntegrityError(f"{message}: {first[0].asDict()}")


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column: whether it exists and how many values it has."""
    have = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in have], F.count(F.lit(1)).alias("_rows"))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"), (F.col(c) if c in have else F.lit(0).cast("long")).alias("non_null"))
        for c in required
    ]
    return counts.select(F.inline(F.array(*rows)))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def invalid_labels(df: DataFrame, column: str, allowed: list) -> DataFrame:
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    return bad.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("occurrences"))


def missingness(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Null ratio per column in one pass; NaN counts as missing.  ``total`` names a column for the number of rows."""
    cols = columns or df.columns
    kinds = dict(df.dtypes)

    def absent(c: str) -> Column:
        test = F.col(c).isNull()
        return test | F.isnan(F.col(c)) if kinds[c] in ("double", "float") else test

    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(absent(c)).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"), F.col("_n").alias("n")) for c in cols]
    ratio = F.when(F.col("n") > 0, F.col("nulls") / F.col("n")).otherwise(F.lit(0.0))
    return wide.select(F.inline(F.array(*rows))).select(
        "column_name", "nulls", round4(ratio).alias("null_ratio"), (ratio > threshold).alias("flagged"), *([F.col("n").alias(total)] if total else [])
    )


def split_overlap(df: DataFrame, key: str, split: str, names: list[str]) -> DataFrame:
    """Ids shared by each pair of splits: one aggregate per id, then a count per pair."""
    member = df.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = member.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}|{b}").alias("shared")) for a, b in pairs
    ]
    return counts.select(F.inline(F.array(*rows)))


def missing_modalities(df: DataFrame, required: list[str], by: list[str] | None = None) -> DataFrame:
    """Required modalities without any row, for the dataset or per group."""
    seen = [F.max((F.col("modality") == m).cast("int")).alias(f"_{m}") for m in required]
    absent = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"_{m}"), F.lit(0)) == 0, F.lit(m)) for m in required]))
    return df.groupBy(*(by or [])).agg(*seen).select(*(by or []), absent.alias("missing_modalities"))


def cohort_integrity(df: DataFrame, key: str, columns: dict[str, list[str]]) -> DataFrame:
    """One row: participants, repeated ids, all-missing rows, fully observed rows and presence per modality.

    Repeated ids are rows minus distinct ids, from one aggregate over ids.
    """
    present = {m: F.coalesce(*[finite(F.col(c)) for c in cols]).isNotNull() for m, cols in columns.items()}
    full = reduce(lambda a, b: a & b, [finite(F.col(c)).isNotNull() for cols in columns.values() for c in cols])
    none = reduce(lambda a, b: a & b, [~p for p in present.values()])
    per_id = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(none).alias("empty"),
        F.count_if(full).alias("full"),
        *[F.count_if(p).alias(f"n_{m}") for m, p in present.items()],
    )
    total = F.sum("rows")
    return per_id.agg(
        total.alias("total_rows"),
        F.count_if((F.col("rows") > 1) | F.col(key).isNull()).alias("bad_ids"),
        F.sum("empty").alias("all_missing"),
        F.sum("full").alias("fully_observed"),
        *[F.sum(f"n_{m}").alias(f"{m}_present") for m in columns],
        *[round4(F.sum(f"n_{m}") / total).alias(f"{m}_ratio") for m in columns],
    )


def integrity_report(df: DataFrame, required: list[str], key: list[str], label: str, allowed: list, threshold: float = 0.5) -> DataFrame:
    """All findings of the column, key, label and missingness checks as (check, subject, count)."""
    cols = check_columns(df, required).where(~F.col("present"))
    dup = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    parts = [
        cols.select(F.lit("missing_column").alias("check"), F.col("column_name").alias("subject"), F.lit(1).cast("long").alias("count")),
        dup.select(F.lit("duplicate_key").alias("check"), F.lit(",".join(key)).alias("subject"), F.col("n").alias("count")),
        invalid_labels(df, label, allowed).select(
            F.lit("invalid_label").alias("check"), F.col("label").cast("string").alias("subject"), F.col("occurrences").alias("count")
        ),
        missingness(df, threshold).where("flagged").select(
            F.lit("missingness").alias("check"), F.col("column_name").alias("subject"), F.col("nulls").alias("count")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, and nulls per column."""
    return missingness(df, total="n_rows").withColumns(
        {"n_columns": F.lit(len(df.columns)).cast("long")}
    ).select("column_name", "nulls", "null_ratio", "n_rows", "n_columns")


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]], max_missing: float = 0.5) -> DataFrame:
    """Missing fraction and out-of-range count per numeric feature, in one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c, (lo, hi) in ranges.items():
        v = finite(F.col(c))
        aggs += [F.count_if((v < lo) | (v > hi)).alias(f"{c}_out"), F.count_if(v.isNull()).alias(f"{c}_null")]
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}_out").alias("out_of_range"),
            round4(F.col(f"{c}_null") / F.col("_n")).alias("missing_fraction"),
            (F.col(f"{c}_null") / F.col("_n") > max_missing).alias("too_sparse"),
        )
        for c in ranges
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def trial_qc(
    samples: DataFrame,
    key: str,
    channels: list[str],
    totals: list[str],
    rate_hz: float = 100.0,
    min_seconds: float = 10.0,
    min_force: float = 1.0,
    max_missing: float = 0.5,
    max_deviation: float = 0.05,
) -> DataFrame:
    """Duration, force floor, channel completeness and sample-count consistency for every trial at once."""
    base = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_samples"),
        (F.max("time") - F.min("time")).alias("duration"),
        *[(F.count_if(finite(F.col(c)).isNull()) / F.count(F.lit(1))).alias(f"null_{c}") for c in channels],
    )
    force = samples.select(
        key, F.inline(F.array(*[F.struct(F.lit(t).alias("total"), F.col(t).cast("double").alias("value")) for t in totals]))
    )
    by = [key, "total"]
    medians = osx.ranked(osx.value_counts(force, by, F.col("value")), by).groupBy(*by).agg(osx.median_expr().alias("m"))
    wide = medians.groupBy(key).agg(*[F.max(F.when(F.col("total") == t, round4(F.col("m")))).alias(f"median_{t}") for t in totals])
    expected = F.floor(F.col("duration") * rate_hz)
    deviation = F.abs(F.col("n_samples") - expected) / F.greatest(expected, F.lit(1))
    issues = [(((F.col("n_samples") > 1) & (F.col("duration") < min_seconds)), "duration")]
    issues += [(F.col(f"median_{t}") < min_force, f"low_force:{t}") for t in totals]
    issues += [(F.col(f"null_{c}") > max_missing, f"missing:{c}") for c in channels]
    return (
        base.join(wide, key, "left")
        .withColumns(
            {
                "issues": reasons(*issues),
                "warnings": reasons((((F.col("n_samples") > 1) & (deviation > max_deviation)), "sample_count")),
            }
        )
        .withColumn("passed", F.size("issues") == 0)
    )


# ---- row constraints -------------------------------------------------------------------------------------------

# Task types each modality accepts.
TASK_TYPES = {
    "typing": ["controlled_phrase", "free_typing"],
    "voice": ["sustained_vowel", "read_sentence", "free_speech"],
    "motor": ["walking", "tapping", "tremor_hold"],
    "visual": ["tracking", "blink", "reaction"],
    "sleep": [],
}
# (column, low, high, null allowed); None leaves a side open.
VALUE_RULES = {
    "typing": [(c, 0, None, False) for c in ("duration", "typing_speed", "mean_inter_key_interval", "std_inter_key_interval", "pause_rate", "correction_rate", "rhythm_variability")]
    + [("quality_score", 0, 1, False)],
    "voice": [("duration", 0, None, False), ("signal_quality", 0, 1, False)]
    + [(c, 0, None, False) for c in ("jitter", "shimmer", "pitch_mean", "pitch_std")]
    + [("hnr", None, None, False), ("quality_score", 0, 1, False)],
    "motor": [("duration", 0, None, False), ("movement_variability", None, None, False), ("quality_score", 0, 1, False)],
    "visual": [("duration", 0, None, False), ("quality_score", 0, 1, False), ("gaze_stability", 0, 1, True), ("tracking_accuracy", 0, 1, True)],
    "sleep": [("sleep_duration", 0, 24, False), ("sleep_quality", 1, 5, False), ("daytime_sleepiness", 1, 5, False), ("score", 0, 100, False)],
}


def validate_sessions(df: DataFrame, modality: str) -> DataFrame:
    """Adds ``errors``: the names of the violated constraints. Narrow; split good and quarantined rows on its size."""
    def outside(rule) -> Column:
        name, lo, hi, nullable = rule
        if name not in df.columns:
            return F.lit(not nullable)
        v = finite(F.col(name))
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (v < lo)
        if hi is not None:
            bad = bad | (v > hi)
        return F.when(v.isNull(), F.lit(not nullable)).otherwise(bad)

    checks = [(~F.coalesce(F.col(c).rlike(fv.UUID_PATTERN), F.lit(False)), f"invalid_{c}") for c in ("participant_id", "session_id")]
    if TASK_TYPES[modality]:
        checks.append((~F.coalesce(F.col("task_type").isin(TASK_TYPES[modality]), F.lit(False)), "invalid_task_type"))
    if modality == "motor":
        checks.append((F.coalesce(F.col("feature_version"), F.lit("")) == "", "missing_feature_version"))
    if modality == "voice" and "mfcc_features" in df.columns:
        checks.append((F.coalesce(F.size("mfcc_features"), F.lit(0)) <= 0, "empty_mfcc_features"))
    if modality == "sleep":
        checks.append((F.col("unusual_movement_self_report").isNull(), "missing_movement_report"))
    checks += [(outside(rule), f"out_of_range_{rule[0]}") for rule in VALUE_RULES[modality]]
    return df.withColumn("errors", reasons(*checks))


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where(F.size("errors") == 0).drop("errors"), validated.where(F.size("errors") > 0)


def no_imputation_errors() -> Column:
    """Violations of 'missing is null': overlap of the arrays, data under a missing modality, none under an available one."""
    per = [
        pair
        for m in fv.MODALITIES
        for pair in (
            (F.array_contains("missing_modalities", m) & F.col(m).isNotNull(), f"imputed:{m}"),
            (F.array_contains("available_modalities", m) & F.col(m).isNull(), f"empty:{m}"),
        )
    ]
    return reasons((F.arrays_overlap("available_modalities", "missing_modalities"), "available_and_missing"), *per)


def audit_no_imputation(daily: DataFrame) -> DataFrame:
    return daily.withColumn("errors", no_imputation_errors())


def validate_daily(daily: DataFrame) -> DataFrame:
    oq = F.col("quality.overall_quality")
    text = F.lower(F.to_json(F.struct(*[F.col(c) for c in daily.columns])))
    checks = reasons(
        (~F.coalesce(F.col("participant_id").cast("string").rlike(fv.UUID_PATTERN), F.lit(False)), "participant_id"),
        (~F.coalesce(F.col("date").cast("string").rlike(fv.DATE_PATTERN), F.lit(False)), "date"),
        (F.coalesce(F.col("feature_version"), F.lit("")) == "", "feature_version"),
        (F.col("available_modalities").isNull(), "available_modalities"),
        (F.col("missing_modalities").isNull(), "missing_modalities"),
        (F.coalesce((oq < 0) | (oq > 1), F.lit(True)), "overall_quality"),
        *[(text.contains(p), f"statement:{p}") for p in fv.VECTOR_FORBIDDEN_STATEMENTS],
    )
    return daily.withColumn("errors", F.concat(checks, F.coalesce(no_imputation_errors(), F.array().cast("array<string>"))))


# ---- leakage ---------------------------------------------------------------------------------------------------

def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def content_duplicates(df: DataFrame, split: str, content: str, names: list[str]) -> DataFrame:
    """Texts that occur in two splits. Rows are counted per (hash, split) first, so a text with millions of copies is one
    row per split and no pairs of copies are formed."""
    per = df.groupBy(content_hash(F.col(content)).alias("h"), split).agg(F.count(F.lit(1)).alias("n"))
    wide = per.groupBy("h").agg(*[F.sum(F.when(F.col(split) == s, F.col("n"))).alias(s) for s in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = [
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(a).alias("na"), F.col(b).alias("nb")) for a, b in pairs
    ]
    return (
        wide.select(F.inline(F.array(*rows)))
        .groupBy("split_a", "split_b")
        .agg(
            F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("shared_texts"),
            F.coalesce(F.sum(F.when(F.col("nb").isNotNull(), F.col("na"))), F.lit(0)).alias("rows_a"),
            F.coalesce(F.sum(F.when(F.col("na").isNotNull(), F.col("nb"))), F.lit(0)).alias("rows_b"),
        )
    )


def leakage_report(df: DataFrame, split: str, key: str, content: str, names: list[str]) -> DataFrame:
    return content_duplicates(df, split, content, names).join(
        F.broadcast(split_overlap(df, key, split, names).withColumnRenamed("shared", "shared_ids")), ["split_a", "split_b"]
    )


def class_balance(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count_if(F.col(label) == 0).alias("control"), F.count_if(F.col(label) == 1).alias("case"), F.count(F.lit(1)).alias("samples")
    )


# ---- payloads --------------------------------------------------------------------------------------------------

def normalized_sex(c: Column) -> Column:
    return F.when(F.lower(F.trim(c.cast("string"))).isin("m", "male", "1"), "male").otherwise("female")


def validate_demographics(df: DataFrame) -> DataFrame:
    age = F.col("age").cast("string").try_cast("double")
    return df.withColumns(
        {
            "age_value": age,
            "sex_value": normalized_sex(F.col("sex")),
            "errors": reasons(
                (F.col("age").isNull(), "age_required"),
                (F.col("age").isNotNull() & age.isNull(), "age_not_numeric"),
                (F.isnan(age) | (age < 18) | (age > 120), "age_out_of_range"),
            ),
        }
    )


# Plausible ranges of a payload field.
PAYLOAD_RANGES = {"jitter": (0.0, 0.5), "cadence": (20.0, 250.0)}


def payload_checks(df: DataFrame) -> DataFrame:
    errors, warnings = [], []
    for name, (lo, hi) in PAYLOAD_RANGES.items():
        v = F.col(name).cast("string").try_cast("double")
        errors.append((F.col(name).isNotNull() & v.isNull(), f"non_numeric:{name}"))
        warnings.append(((v < lo) | (v > hi), f"out_of_range:{name}"))
    return df.withColumns({"errors": reasons(*errors), "warnings": reasons(*warnings)})


def validate_versions(df: DataFrame) -> DataFrame:
    def stamp(c: str):
        return F.col(c).isNull() | F.try_to_timestamp(F.col(c).cast("string")).isNull()

    return df.withColumn(
        "errors",
        reasons(
            (~F.coalesce(F.col("baseline_version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)), "baseline_version"),
            (F.col("algorithm_version").isNull(), "algorithm_version"),
            (stamp("baseline_created_at"), "baseline_created_at"),
            (stamp("baseline_updated_at"), "baseline_updated_at"),
            (F.coalesce(F.col("sample_count") < 1, F.lit(True)), "sample_count"),
        ),
    )
