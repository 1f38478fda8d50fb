"""Per-row scoring expressions: built-in functions only, so each query is one generated-code stage over the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.functions.numeric import clamp, first_present, reasons, round4, round_half_away


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.col(name).cast("double") if name in df.columns else default


def olfactory_features(df: DataFrame) -> DataFrame:
    score = F.col("total_score").cast("double")
    null = F.lit(None).cast("double")
    return df.withColumns(
        {
            "total_score": score,
            "pct_correct": round4(score / 40.0),
            "response_time_mean": _optional(df, "response_time_mean", null),
            "n_errors": _optional(df, "n_errors", 40.0 - score),
            "error_pattern_flags": _optional(df, "error_pattern_flags", F.lit(0.0)),
        }
    )


RBD_ITEMS = [f"item_{i}" for i in range(1, 14)]


def rbd_features(df: DataFrame) -> DataFrame:
    total = F.col("rbdsq_total").cast("double")
    items = {c: _optional(df, c, F.lit(None).cast("double")) for c in RBD_ITEMS}
    return df.withColumns(
        {
            "rbdsq_total": total,
            "above_cutoff_flag": F.when(total >= 5, 1.0).otherwise(0.0),
            **items,
            "high_weight_item_flags": F.coalesce(items["item_6"], F.lit(0.0)),
        }
    )


# Plausible bounds applied before modelling.
CLAMP_BOUNDS = {
    "total_score": (0.0, 40.0),
    "gait_speed_m_per_s": (0.0, 3.0),
    "cadence_steps_per_min": (0.0, 200.0),
    "stride_interval_cv_pct": (0.0, 50.0),
}


def clamp_columns(df: DataFrame, bounds: dict[str, tuple[float, float]] = CLAMP_BOUNDS, label: str | None = None, allowed=(0, 1)) -> DataFrame:
    out = df.withColumns({c: clamp(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})
    return out.where(F.col(label).isin(list(allowed))) if label else out


def resolve_aliases(df: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    return df.withColumns({name: first_present(df.columns, aliases) for name, aliases in spec.items()})


# ---- model inputs ----------------------------------------------------------------------------------------------

# Further measured inputs, passed through under their own names.
ACOUSTIC = [
    "jitter_abs", "jitter_rap", "jitter_ppq5", "jitter_ddp", "shimmer_db", "shimmer_apq3", "shimmer_apq5", "shimmer_apq11", "shimmer_dda",
    "nhr", "rpde", "dfa", "ppe",
]
GAIT = ["stride_interval_mean_s", "step_regularity", "symmetry_index_pct", "accel_variance", "stance_swing_ratio"]
# Questionnaire items set for a total at the cutoff when no answers are given.
CUTOFF_ITEMS = [1, 3, 5, 7]


def _answers(df: DataFrame) -> Column:
    """Item answers as an array of 0 and 1: ``item_responses``, or ``items`` if those are absent or empty."""
    found = F.lit(None).cast("array<int>")
    for name in ("items", "item_responses"):
        if name in df.columns:
            bits = F.transform(F.col(name), lambda x: F.coalesce(x.cast("double") != 0, F.lit(False)).cast("int"))
            found = F.when(F.size(bits) > 0, bits).otherwise(found) if name == "item_responses" else bits
    return found


def map_to_model_inputs(df: DataFrame) -> DataFrame:
    """Flat daily features to model inputs. Proxies fill only what no task measured, and each one used is named.

    Further acoustic inputs pass only beside a main one.  Absent demographics become 65 and female.  The total is the given one,
    else the number of answered items, else a proxy; without 13 answers, items are set from the cutoff.
    """
    def get(*names: str) -> Column:
        return first_present(df.columns, list(names))

    jitter, shimmer, hnr, pitch = get("jitter", "jitter_pct"), get("shimmer"), get("hnr"), get("pitch_mean", "f0_mean_hz")
    cadence = get("cadence", "gait_cadence", "cadence_steps_per_min")
    stride, taps = get("stride_variability", "stride_interval_cv_pct"), get("tapping_rate")
    tremor, speed = get("tremor_frequency"), get("gait_speed_m_per_s", "speed")
    typing, rhythm, corrections = get("typing_speed"), get("interval_variability"), get("correction_rate")
    reaction, blink, gaze = get("reaction_time"), get("blink_rate"), get("gaze_stability")
    movement, direct = get("unusual_movement_self_report", "dream_enactment"), get("rbdsq_total")
    sleep = get("sleep_quality", "score", "rbdsq_total")
    answers, gait = _answers(df), {c: get(c) for c in GAIT}
    answered = F.coalesce(F.size(answers) > 0, F.lit(False))
    sex = F.lower(F.trim(F.col("sex").cast("string"))) if "sex" in df.columns else F.lit(None).cast("string")

    above = F.when(movement >= 0.5, 1.0).otherwise(0.0)
    scaled = F.coalesce(F.when(sleep > 13, sleep / 100.0 * 13.0).otherwise(sleep), F.lit(5.0))
    has_rbd = F.coalesce(movement, sleep, direct).isNotNull() | answers.isNotNull()
    proxy = clamp(above * 6.0 + scaled * 0.5, 0, 13)
    counted = F.when(answered, F.aggregate(answers, F.lit(0), lambda a, x: a + x).cast("double"))
    total = F.when(has_rbd, F.coalesce(direct, counted, proxy))
    flag = F.when(has_rbd, F.when(total >= 5, 1.0).otherwise(0.0))
    from_cutoff = F.array(*[flag.cast("int") if i in CUTOFF_ITEMS else F.lit(0) for i in range(1, 14)])
    items = F.when(has_rbd, F.when(answered & (F.size(answers) >= 13), F.slice(answers, 1, 13)).otherwise(from_cutoff))
    uses_proxy = has_rbd & direct.isNull() & ~answered
    has_voice = F.coalesce(jitter, shimmer, hnr, pitch).isNotNull()
    has_motor = F.coalesce(cadence, stride, taps, tremor, speed, typing, rhythm, corrections, reaction, *gait.values()).isNotNull()
    return df.withColumns(
        {
            "in_jitter_pct": jitter,
            "in_shimmer": shimmer,
            "in_hnr": hnr,
            "in_f0_mean_hz": pitch,
            "in_cadence_steps_per_min": cadence,
            "in_stride_interval_cv_pct": stride,
            "in_tapping_rate": F.coalesce(taps, typing),
            "in_tapping_interval_variability": rhythm,
            "in_fine_motor_indicator": corrections,
            "in_reaction_time": reaction,
            "in_rbdsq_total": total,
            "in_above_cutoff_flag": flag,
            "in_high_weight_item_flags": flag,
            "in_item_responses": items,
            **{f"in_item_{i}": items[i - 1].cast("double") for i in range(1, 14)},
            **{f"in_{c}": F.when(has_voice, get(c)) for c in ACOUSTIC},
            "in_tremor_frequency": tremor,
            "in_gait_speed_m_per_s": speed,
            "in_typing_speed_proxy": typing,
            **{f"in_{c}": v for c, v in gait.items()},
            "in_blink_rate": blink,
            "in_gaze_stability": gaze,
            "in_age": F.coalesce(get("age"), F.lit(65.0)),
            "in_sex": F.when(sex.isin("m", "male", "1"), "male").otherwise("female"),
            "available_inputs": reasons((has_voice, "voice"), (has_motor, "motor"), (has_rbd, "rbd")),
            "missing_inputs": reasons(
                (~has_voice, "voice"), (~has_motor, "motor"), (~has_rbd, "rbd"), (F.lit(True), "retina"), (F.lit(True), "olfactory")
            ),
            "activated_proxies": reasons(
                (typing.isNotNull(), "typing.typing_speed -> motor.tapping_rate"),
                (rhythm.isNotNull(), "typing.interval_variability -> motor.tapping_interval_variability"),
                (corrections.isNotNull(), "typing.correction_rate -> motor.fine_motor_indicator"),
                (reaction.isNotNull(), "visual.reaction_time -> motor.reaction_time"),
                (uses_proxy & movement.isNotNull(), "sleep.unusual_movement_self_report -> rbd.above_cutoff_flag"),
                (uses_proxy & sleep.isNotNull(), "sleep.sleep_quality -> rbd.item_subscores"),
                (blink.isNotNull(), "visual.blink_rate -> facial.blink_rate"),
                (gaze.isNotNull(), "visual.gaze_stability -> facial.expression_variability"),
            ),
        }
    )


# ---- session scores --------------------------------------------------------------------------------------------

# Sleep duration bands: hours from, hours to, points; the first band that holds the value counts.
SLEEP_BANDS = [(7.0, 9.0, 30.0), (6.5, 9.5, 26.0), (6.0, 10.0, 22.0), (5.0, 11.0, 15.0), (4.0, 12.0, 8.0)]


def sleep_score(df: DataFrame) -> DataFrame:
    """0-100 composite of duration, quality (1-5), reported movement and sleepiness (1-5); invalid answers give null."""
    hours, quality, sleepy = (F.col(c).cast("double") for c in ("sleep_duration", "sleep_quality", "daytime_sleepiness"))
    valid = hours.between(0, 24) & quality.between(1, 5) & sleepy.between(1, 5)
    bands = reduce(lambda acc, b: acc.when(hours.between(b[0], b[1]), b[2]), SLEEP_BANDS[1:], F.when(hours.between(*SLEEP_BANDS[0][:2]), SLEEP_BANDS[0][2]))
    answer = F.lower(F.col("movement_response"))
    movement = F.when(answer == "yes", 0.0).when(answer.isin("not_sure", "dont_know"), 15.0).otherwise(25.0)
    total = bands.otherwise(0.0) + (quality - 1) / 4 * 30.0 + movement + (5 - sleepy) / 4 * 15.0
    return df.withColumn("sleep_score", F.when(valid, clamp(F.floor(total * 10 + 0.5) / 10.0, 0, 100)))


def _score(parts: list[tuple[str, Column, Column | float, str]], digits: int, more: list[tuple[Column, str]] | None = None) -> dict[str, Column]:
    """Sum of the weights whose condition holds, the points of each factor (``breakdown``) and the names of those that fail.

    A part is (factor, condition, weight, reason).  A weight may itself be a column; then it is added as it is and the
    condition only decides on the reason.  ``more`` replaces the reasons where a factor has several.
    """
    points = [w if isinstance(w, Column) else F.when(ok, F.lit(w)).otherwise(0.0) for _, ok, w, _ in parts]
    rounded = round_half_away(clamp(reduce(lambda a, b: a + b, points), 0, 1), digits)
    named = more or [(ok, name) for _, ok, _, name in parts]
    return {
        "quality": rounded,
        "baseline_eligible": rounded >= fv.MIN_QUALITY,
        "rejection_reasons": reasons(*[(~F.coalesce(ok, F.lit(False)), name) for ok, name in named]),
        "breakdown": F.struct(*[p.alias(factor) for p, (factor, *_) in zip(points, parts, strict=True)]),
    }


def typing_quality(df: DataFrame) -> DataFrame:
    keys = F.coalesce(F.col("keystroke_count"), F.lit(0))
    interrupted = F.coalesce(F.col("max_interval_ms") > 10000, F.lit(False))
    ratio = F.when(keys > 0, F.coalesce(F.col("correction_count"), F.lit(0)) / keys).otherwise(0.0)
    cols = _score(
        [
            ("task_completed", F.col("completed"), 0.30, "not_completed"),
            ("sufficient_samples", keys > 20, 0.20, "few_keystrokes"),
            ("no_abnormal_interruptions", ~interrupted & (keys > 0), 0.20, "interrupted"),
            ("reasonable_speed", F.col("typing_speed") > 0.5, 0.15, "slow"),
            ("no_excessive_corrections", (ratio <= 0.5) & (keys > 0), 0.15, "many_corrections"),
        ],
        3,
    )
    # With no keystroke at all the interruption and correction checks give no points but no reason either.
    silent = F.when(keys > 0, F.col("rejection_reasons")).otherwise(
        F.filter("rejection_reasons", lambda r: ~r.isin("many_corrections") & ((r != "interrupted") | interrupted))
    )
    return df.withColumns(cols).withColumn("rejection_reasons", silent)


def voice_quality(df: DataFrame) -> DataFrame:
    return df.withColumns(
        _score(
            [
                ("sufficient_duration", F.col("duration") > 3.0, 0.30, "short"),
                ("good_snr", F.col("signal_quality") >= 0.5, 0.30, "noisy"),
                ("no_clipping", ~F.col("clipping_detected"), 0.20, "clipped"),
                ("low_silence", F.col("silence_ratio") < 0.30, 0.20, "silent"),
            ],
            2,
        )
    )


def motor_quality(df: DataFrame, task: str) -> DataFrame:
    """Quality, reasons and points per factor of a motor task.

    Cadence and regularity share the points of a walk's signal but are named apart; an amplitude that could not be extracted
    is named so instead of as movement.
    """
    d = F.col("duration_seconds")
    named = None
    if task == "walking":
        cadence, regular = F.col("cadence").between(30, 200), F.col("movement_regularity") >= 0.3
        parts = [
            ("sensor_available", F.col("sensor_available"), 0.3, "no_sensor"),
            ("task_completed", d >= 25, 0.3, "short"),
            ("sufficient_steps", F.col("step_count") > 10, 0.2, "few_steps"),
            ("signal_quality", cadence & regular, 0.2, "irregular"),
        ]
        named = [(ok, name) for _, ok, _, name in parts[:-1]] + [(cadence, "cadence_out_of_range"), (regular, "irregular")]
    elif task == "tapping":
        variability = F.col("inter_tap_interval_variability")
        parts = [
            ("task_completed", d >= 8, 0.3, "short"),
            ("sufficient_taps", F.col("tap_count") > 10, 0.3, "few_taps"),
            ("no_abnormal_interruptions", variability.isNull() | (variability <= 0.3), 0.2, "interrupted"),
            ("reasonable_tap_rate", F.col("tapping_rate").between(0.5, 15), 0.2, "implausible_rate"),
        ]
    elif task == "tremor_hold":
        amplitude = F.col("tremor_amplitude")
        strong = (F.col("sample_count") >= 50) & (F.col("extraction_status") == "ok")
        parts = [
            ("task_completed", d >= 8, 0.3, "short"),
            ("phone_held_still", amplitude <= 2.0, 0.3, "moved"),
            ("sufficient_signal_quality", strong, 0.2, "weak_signal"),
            ("no_excessive_movement", amplitude <= 5.0, 0.2, "artifact"),
        ]
        known = amplitude.isNotNull()
        named = [(d >= 8, "short"), (~known | (amplitude <= 2.0), "moved"), (known, "no_amplitude"), (strong, "weak_signal"), (amplitude <= 5.0, "artifact")]
    else:
        raise ValueError(f"unknown motor task {task}")
    return df.withColumns(_score(parts, 2, named))


# Target seconds of a visual task.
VISUAL_SECONDS = {"tracking": 20.0, "blink": 30.0, "reaction": 25.0}


def visual_quality(df: DataFrame) -> DataFrame:
    def part(x: Column, full: float, floor: float, weight: float) -> Column:
        return F.when(x >= full, weight).when(x >= floor, round_half_away(x / full * weight, 2)).otherwise(0.0)

    target = reduce(lambda acc, kv: acc.when(F.col("task_type") == kv[0], kv[1]), list(VISUAL_SECONDS.items())[1:], F.when(F.col("task_type") == "tracking", 20.0)).otherwise(20.0)
    face, light, sure = F.col("face_detected_ratio"), F.col("good_lighting_ratio"), F.col("mean_confidence")
    done, head = F.col("duration") / target, F.col("head_displacement")
    steady = F.when(head <= 0.05, 0.1).when(head <= 0.12, 0.05).otherwise(0.0)
    return df.withColumns(
        _score(
            [
                ("face_detected", face >= 0.85, part(face, 0.85, 0.50, 0.3), "face"),
                ("good_lighting", light >= 0.80, part(light, 0.80, 0.50, 0.2), "lighting"),
                ("tracking_confidence", sure >= 0.70, part(sure, 0.70, 0.40, 0.2), "confidence"),
                ("task_completed", done >= 0.85, part(done, 0.85, 0.50, 0.2), "incomplete"),
                ("head_stability", head <= 0.05, steady, "head_motion"),
            ],
            2,
        )
    )


# ---- dashboard and identity ------------------------------------------------------------------------------------

def baseline_band(df: DataFrame) -> DataFrame:
    mean, std = F.col("baseline_mean"), F.col("baseline_std")
    return df.withColumns({"band_low": round_half_away(mean - std, 3), "band_high": round_half_away(mean + std, 3)})


def adherence(df: DataFrame, done: str, total: str) -> DataFrame:
    pct = F.least(F.lit(100), F.floor(F.col(done) / F.greatest(F.col(total), F.lit(1)) * 100 + 0.5))
    return df.withColumn("adherence_pct", pct).withColumn("target_met", F.col("adherence_pct") >= 70)


def risk_pattern(df: DataFrame, score: str) -> DataFrame:
    """Dashboard band and log pattern of a risk score; a null score is incomplete, never a middle value."""
    s = clamp(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), 0, 1)
    shown = F.coalesce(s, F.lit(0.0))
    return df.withColumns(
        {
            "dashboard_pattern": F.when(shown >= 0.65, "elevated").when(shown >= 0.40, "moderate").otherwise("within_baseline"),
            "log_pattern": F.when(s.isNull(), "incomplete").when(round4(s) >= 0.5, "elevated").otherwise("standard"),
        }
    )


def pseudonymize(df: DataFrame, column: str, salt: str, out: str = "pseudonymous_id") -> DataFrame:
    digest = F.sha2(F.concat(F.col(column).cast("string"), F.lit(":" + salt)), 256)
    return df.withColumn(out, F.concat(F.lit("ps_"), F.substring(digest, 1, 24)))


def idempotency_key(session: Column, participant: Column, time: Column) -> Column:
    text = F.concat_ws("_", session.cast("string"), participant.cast("string"), time.cast("string"))
    return F.concat(F.lit("idmp_"), F.substring(F.sha2(text, 256), 1, 32))
