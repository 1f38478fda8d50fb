"""C: per-row scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import baseline as bl
from driftwell.operators import projections as pj
from driftwell.plans import tables as tb
from driftwell.plans.quality_queries import _errs
from driftwell.plans.registry import query
from driftwell.plans.sqltext import SESSIONS, baseline_ctes, r4, rn

LI = "lineitem"


def _li(spark, sf, **cols):
    key = ["l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey"]
    return tb.table(spark, sf, LI).select(*key, *[c.alias(n) for n, c in cols.items()])


KEY = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"


@query(
    "C1_olfactory_features",
    f"""SELECT {KEY}, l_quantity AS total_score, {r4("(l_quantity/4e1)")} AS pct_correct, l_tax AS response_time_mean, 4e1-l_quantity AS n_errors, 0e0 AS error_pattern_flags FROM lineitem""",
)
def olfactory(spark, sf):
    return pj.olfactory_features(_li(spark, sf, total_score=F.col("l_quantity"), response_time_mean=F.col("l_tax")))


@query(
    "C2_rbd_features",
    f"""SELECT {KEY}, CAST(l_linenumber AS DOUBLE) AS rbdsq_total, CASE WHEN l_linenumber >= 5 THEN 1e0 ELSE 0e0 END AS above_cutoff_flag,
  CASE WHEN l_quantity > 30 THEN 1e0 END AS item_6, CASE WHEN l_quantity > 30 THEN 1e0 ELSE 0e0 END AS high_weight_item_flags FROM lineitem""",
)
def rbd(spark, sf):
    src = _li(spark, sf, rbdsq_total=F.col("l_linenumber"), item_6=F.when(F.col("l_quantity") > 30, 1))
    return pj.rbd_features(src).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rbdsq_total", "above_cutoff_flag", "item_6", "high_weight_item_flags")


@query(
    "C3_clamp",
    f"""SELECT {KEY}, least(greatest(l_quantity, 0), 4e1) AS total_score, least(greatest(l_extendedprice/2e4, 0), 3e0) AS gait_speed_m_per_s,
  CAST(l_linenumber AS BIGINT) AS label FROM lineitem WHERE l_linenumber IN (0, 1)""",
)
def clamp(spark, sf):
    src = _li(spark, sf, total_score=F.col("l_quantity"), gait_speed_m_per_s=F.col("l_extendedprice") / 2e4, label=F.col("l_linenumber"))
    return pj.clamp_columns(src, label="label")


@query(
    "C4_channel_sums",
    f"""WITH x AS (SELECT *, nullif(l_tax, 0) AS a, nullif(l_discount, 0) AS b FROM lineitem)
SELECT {KEY}, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN {r4("(coalesce(a, 0e0)+coalesce(b, 0e0))")} END AS total FROM x""",
)
def channel_sums(spark, sf):
    from driftwell.functions.numeric import null_safe_sum, round4

    a, b = F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.0))
    return _li(spark, sf, total=round4(null_safe_sum([a, b])))


@query(
    "C5_resolve_aliases",
    f"""SELECT {KEY}, coalesce(nullif(l_tax, 0), l_discount) AS typing_speed, CAST(NULL AS DOUBLE) AS hnr FROM lineitem""",
)
def aliases(spark, sf):
    src = _li(spark, sf, typing_speed_cpm=F.nullif(F.col("l_tax"), F.lit(0.0)), speed=F.col("l_discount"))
    return pj.resolve_aliases(src, {"typing_speed": ["typing_speed", "typing_speed_cpm", "speed"], "hnr": ["hnr"]}).drop("typing_speed_cpm", "speed")


PROXY = """m AS (SELECT event_id, value, k, modality, CASE WHEN modality = 'typing' THEN value END AS typ, CASE WHEN modality = 'motor' THEN value END AS taps,
  CASE WHEN modality = 'visual' THEN value END AS react, CASE WHEN modality = 'voice' THEN k/1e2 END AS jit,
  CASE WHEN modality = 'sleep' AND k >= 20 THEN CAST(k AS DOUBLE) END AS sq, CASE WHEN modality = 'sleep' AND k < 60 THEN CAST(k < 30 AS DOUBLE) END AS mov FROM sessions),
p AS (SELECT *, sq IS NOT NULL OR mov IS NOT NULL AS rbd, least(greatest((CASE WHEN mov >= 0.5 THEN 1e0 ELSE 0e0 END)*6e0 + coalesce(CASE WHEN sq > 13 THEN sq/1e2*1.3e1 ELSE sq END, 5e0)*0.5::DOUBLE, 0e0), 1.3e1) AS tot FROM m)"""


@query(
    "C6_model_inputs",
    f"""WITH {SESSIONS}, {PROXY}
SELECT event_id, jit AS in_jitter_pct, coalesce(taps, typ) AS in_tapping_rate, react AS in_reaction_time, CASE WHEN rbd THEN {r4("tot")} END AS in_rbdsq_total,
  CASE WHEN rbd THEN CASE WHEN tot >= 5 THEN 1e0 ELSE 0e0 END END AS in_above_cutoff_flag,
  {_errs(("jit IS NOT NULL", "voice"), ("taps IS NOT NULL OR typ IS NOT NULL OR react IS NOT NULL", "motor"), ("rbd", "rbd"))} AS available_inputs,
  {_errs(("typ IS NOT NULL", "typing.typing_speed -> motor.tapping_rate"), ("react IS NOT NULL", "visual.reaction_time -> motor.reaction_time"), ("mov IS NOT NULL", "sleep.unusual_movement_self_report -> rbd.above_cutoff_flag"), ("sq IS NOT NULL", "sleep.sleep_quality -> rbd.item_subscores"))} AS activated_proxies
FROM p""",
)
def model_inputs(spark, sf):
    s = tb.sessions(spark, sf)
    m, k = F.col("modality"), F.col("k")
    src = s.select(
        "event_id",
        F.when(m == "typing", F.col("value")).alias("typing_speed"),
        F.when(m == "motor", F.col("value")).alias("tapping_rate"),
        F.when(m == "visual", F.col("value")).alias("reaction_time"),
        F.when(m == "voice", k / 100.0).alias("jitter"),
        F.when((m == "sleep") & (k >= 20), k.cast("double")).alias("sleep_quality"),
        F.when((m == "sleep") & (k < 60), (k < 30).cast("double")).alias("unusual_movement_self_report"),
    )
    out = pj.map_to_model_inputs(src)
    cols = ["event_id", "in_jitter_pct", "in_tapping_rate", "in_reaction_time", "in_rbdsq_total", "in_above_cutoff_flag", "available_inputs", "activated_proxies"]
    return out.withColumn("in_rbdsq_total", pj.round4(F.col("in_rbdsq_total"))).select(*cols)


# The inputs that C6_model_inputs leaves out: acoustic and gait values, demographics and questionnaire items.
_acoustic = ", ".join(f"CASE WHEN modality = 'voice' AND k % 7 > 0 AND k % 13 <> {i} THEN k/1e2+{i} END AS in_{c}" for i, c in enumerate(pj.ACOUSTIC))
_gait = ", ".join(f"CASE WHEN modality = 'motor' AND k % 7 = {i} THEN CAST(k+{i} AS DOUBLE) END AS in_{c}" for i, c in enumerate(pj.GAIT))
_item = ", ".join(f"CASE WHEN k % {i + 2} = 0 THEN 1 ELSE 0 END" for i in range(13))


@query(
    "C6_model_inputs_rest",
    f"""WITH {SESSIONS}, a AS (SELECT *, modality = 'sleep' AND k < 80 AS rbd, CASE WHEN modality = 'sleep' AND k < 30 THEN [{_item}] WHEN modality = 'sleep' AND k < 50 THEN [{_item}][1:6] END AS answers FROM sessions),
t AS (SELECT *, CASE WHEN rbd THEN CAST(coalesce(list_sum(answers), CASE WHEN k >= 60 THEN 6.0 + k/1e2*1.3e1*0.5::DOUBLE ELSE k/1e2*1.3e1*0.5::DOUBLE END) AS DOUBLE) END AS tot FROM a),
c AS (SELECT *, CASE WHEN k < 30 THEN answers ELSE [CASE WHEN i IN (1, 3, 5, 7) AND tot >= 5 THEN 1 ELSE 0 END FOR i IN range(1, 14)] END AS it FROM t)
SELECT event_id, {_acoustic}, {_gait}, CASE WHEN k >= 40 THEN CAST(k AS DOUBLE) ELSE 6.5e1 END AS in_age, CASE WHEN k % 3 = 0 THEN 'male' ELSE 'female' END AS in_sex,
  CASE WHEN rbd THEN {r4("tot")} END AS in_rbdsq_total, CASE WHEN rbd THEN array_to_string(it, '|') END AS in_item_responses, CASE WHEN rbd THEN CAST(it[3] AS DOUBLE) END AS in_item_3,
  {_errs(("modality = 'voice' AND k % 7 > 0", "voice"), (f"modality = 'motor' AND k % 7 < {len(pj.GAIT)}", "motor"), ("rbd", "rbd"))} AS available_inputs
FROM c""",
)
def model_inputs_rest(spark, sf):
    m, k = F.col("modality"), F.col("k")
    item = F.array(*[F.when(k % (i + 2) == 0, 1).otherwise(0) for i in range(13)])
    src = tb.sessions(spark, sf).select(
        "event_id",
        F.when((m == "voice") & (k % 7 > 0), k / 100.0).alias("jitter"),
        *[F.when((m == "voice") & (k % 13 != i), k / 100.0 + i).alias(c) for i, c in enumerate(pj.ACOUSTIC)],
        *[F.when((m == "motor") & (k % 7 == i), (k + i).cast("double")).alias(c) for i, c in enumerate(pj.GAIT)],
        F.when(k >= 40, k).alias("age"),
        F.when(k % 3 == 0, " Male").when(k % 3 == 1, "f").alias("sex"),
        F.when((m == "sleep") & (k < 30), item).alias("item_responses"),
        F.when((m == "sleep") & k.between(30, 49), F.slice(item, 1, 6)).alias("items"),
        F.when((m == "sleep") & k.between(50, 79), k.cast("double")).alias("sleep_quality"),
        F.when((m == "sleep") & k.between(60, 79), 1.0).alias("dream_enactment"),
    )
    out = pj.map_to_model_inputs(src)
    cols = [f"in_{c}" for c in [*pj.ACOUSTIC, *pj.GAIT, "age", "sex", "rbdsq_total", "item_responses", "item_3"]]
    return out.withColumn("in_rbdsq_total", pj.round4(F.col("in_rbdsq_total"))).select("event_id", *cols, "available_inputs")


@query(
    "C7_sleep_score",
    f"""WITH {SESSIONS}, a AS (SELECT event_id, value/1e1 AS h, 1+k//20 AS q, 1+k//25 AS s, CASE WHEN k >= 80 THEN 'YES' WHEN k >= 60 THEN 'not_sure' ELSE 'no' END AS mv FROM sessions)
SELECT event_id, CASE WHEN h BETWEEN 0 AND 24 AND q BETWEEN 1 AND 5 AND s BETWEEN 1 AND 5 THEN
  least(greatest(floor((CASE WHEN h BETWEEN 7 AND 9 THEN 3e1 WHEN h BETWEEN 6.5::DOUBLE AND 9.5::DOUBLE THEN 2.6e1 WHEN h BETWEEN 6 AND 10 THEN 2.2e1 WHEN h BETWEEN 5 AND 11 THEN 1.5e1 WHEN h BETWEEN 4 AND 12 THEN 8e0 ELSE 0e0 END
   + (q-1)/4e0*3e1 + CASE lower(mv) WHEN 'yes' THEN 0e0 WHEN 'not_sure' THEN 1.5e1 ELSE 2.5e1 END + (5-s)/4e0*1.5e1)*1e1+0.5)/1e1, 0e0), 1e2) END AS sleep_score FROM a""",
)
def sleep_score(spark, sf):
    k = F.col("k")
    src = tb.sessions(spark, sf).select(
        "event_id",
        (F.col("value") / 10.0).alias("sleep_duration"),
        (1 + F.floor(k / 20)).alias("sleep_quality"),
        (1 + F.floor(k / 25)).alias("daytime_sleepiness"),
        F.when(k >= 80, "YES").when(k >= 60, "not_sure").otherwise("no").alias("movement_response"),
    )
    return pj.sleep_score(src).select("event_id", "sleep_score")


def _weights(*parts: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0e0 END" for c, w in parts)


def _quality_sql(view: str, parts: list[tuple[str, float, str]], digits: int, reasons: str | None = None) -> str:
    total = f"least(greatest({_weights(*[(c, w) for c, w, _ in parts])}, 0e0), 1e0)"
    why = reasons or _errs(*[(f"NOT coalesce({c}, FALSE)", n) for c, _, n in parts])
    return f"""WITH {SESSIONS}, v AS ({view}), t AS (SELECT *, {total} AS total FROM v)
SELECT event_id, {rn("total", digits)} AS quality, {rn("total", digits)} >= 0.5 AS baseline_eligible, {why} AS rejection_reasons FROM t"""


Q = ["event_id", "quality", "baseline_eligible", "rejection_reasons"]


def _breakdown_sql(view: str, factors: list[tuple[str, str]]) -> str:
    return f"WITH {SESSIONS}, v AS ({view}) SELECT event_id, " + ", ".join(f"{points} AS {name}" for name, points in factors) + " FROM v"


def _points(parts: list[tuple[str, float, str]], names: str) -> list[tuple[str, str]]:
    return [(name, _weights((c, w))) for name, (c, w, _) in zip(names.split(), parts, strict=True)]


TYPING = (
    "SELECT event_id, k > 10 AS done, k AS keys, value*100 AS gap, value/1e2 AS speed, k//3 AS corr FROM sessions",
    [("done", 0.3, "not_completed"), ("keys > 20", 0.2, "few_keystrokes"), ("gap <= 10000 AND keys > 0", 0.2, "interrupted"), ("speed > 0.5", 0.15, "slow"), ("keys > 0 AND corr/CAST(keys AS DOUBLE) <= 0.5", 0.15, "many_corrections")],
)


@query(
    "C8_typing_quality",
    _quality_sql(
        *TYPING,
        3,
        _errs(("NOT done", "not_completed"), ("keys <= 20", "few_keystrokes"), ("gap > 10000", "interrupted"), ("speed <= 0.5", "slow"), ("keys > 0 AND corr/CAST(keys AS DOUBLE) > 0.5", "many_corrections")),
    ),
)
def typing_quality(spark, sf):
    return _typing(spark, sf).select(*Q)


@query("C8_typing_breakdown", _breakdown_sql(TYPING[0], _points(TYPING[1], "task_completed sufficient_samples no_abnormal_interruptions reasonable_speed no_excessive_corrections")))
def typing_breakdown(spark, sf):
    return _typing(spark, sf).select("event_id", "breakdown.*")


def _typing(spark, sf):
    k, v = F.col("k"), F.col("value")
    src = tb.sessions(spark, sf).select(
        "event_id", (k > 10).alias("completed"), k.alias("keystroke_count"), (v * 100).alias("max_interval_ms"), (v / 100.0).alias("typing_speed"), F.floor(k / 3).alias("correction_count")
    )
    return pj.typing_quality(src)


VOICE = (
    "SELECT event_id, value/1e1 AS d, k/1e2 AS q, k > 90 AS clip, value/1e2 AS sil FROM sessions",
    [("d > 3", 0.3, "short"), ("q >= 0.5", 0.3, "noisy"), ("NOT clip", 0.2, "clipped"), ("sil < 0.3::DOUBLE", 0.2, "silent")],
)


@query("C9_voice_quality", _quality_sql(*VOICE, 2))
def voice_quality(spark, sf):
    return _voice(spark, sf).select(*Q)


@query("C9_voice_breakdown", _breakdown_sql(VOICE[0], _points(VOICE[1], "sufficient_duration good_snr no_clipping low_silence")))
def voice_breakdown(spark, sf):
    return _voice(spark, sf).select("event_id", "breakdown.*")


def _voice(spark, sf):
    k, v = F.col("k"), F.col("value")
    src = tb.sessions(spark, sf).select(
        "event_id", (v / 10.0).alias("duration"), (k / 100.0).alias("signal_quality"), (k > 90).alias("clipping_detected"), (v / 100.0).alias("silence_ratio")
    )
    return pj.voice_quality(src)


MOTOR = {
    "walking": (
        "SELECT event_id, k > 5 AS s, value AS d, k//4 AS n, value*2 AS c, k/1e2 AS r FROM sessions",
        [("s", 0.3, "no_sensor"), ("d >= 25", 0.3, "short"), ("n > 10", 0.2, "few_steps"), ("c BETWEEN 30 AND 200 AND r >= 0.3::DOUBLE", 0.2, "irregular")],
    ),
    "tapping": (
        "SELECT event_id, value/4e0 AS d, k//4 AS n, CASE WHEN k >= 50 THEN k/1e2-0.5::DOUBLE END AS c, value/1e1 AS r FROM sessions",
        [("d >= 8", 0.3, "short"), ("n > 10", 0.3, "few_taps"), ("c IS NULL OR c <= 0.3::DOUBLE", 0.2, "interrupted"), ("r BETWEEN 0.5 AND 15", 0.2, "implausible_rate")],
    ),
    "tremor_hold": (
        "SELECT event_id, value/4e0 AS d, CASE WHEN k > 5 THEN k/1e1 END AS a, k AS n, k > 30 AS ok FROM sessions",
        [("d >= 8", 0.3, "short"), ("a <= 2", 0.3, "moved"), ("n >= 50 AND ok", 0.2, "weak_signal"), ("a <= 5", 0.2, "artifact")],
    ),
}


def _motor(spark, sf, task):
    k, v = F.col("k"), F.col("value")
    s = tb.sessions(spark, sf)
    if task == "walking":
        src = s.select("event_id", (k > 5).alias("sensor_available"), v.alias("duration_seconds"), F.floor(k / 4).alias("step_count"), (v * 2).alias("cadence"), (k / 100.0).alias("movement_regularity"))
    elif task == "tapping":
        src = s.select("event_id", (v / 4.0).alias("duration_seconds"), F.floor(k / 4).alias("tap_count"), F.when(k >= 50, k / 100.0 - 0.5).alias("inter_tap_interval_variability"), (v / 10.0).alias("tapping_rate"))
    else:
        src = s.select("event_id", (v / 4.0).alias("duration_seconds"), F.when(k > 5, k / 10.0).alias("tremor_amplitude"), k.alias("sample_count"), F.when(k > 30, "ok").otherwise("failed").alias("extraction_status"))
    return pj.motor_quality(src, task)


MOTOR_FACTORS = {
    "walking": "sensor_available task_completed sufficient_steps signal_quality",
    "tapping": "task_completed sufficient_taps no_abnormal_interruptions reasonable_tap_rate",
    "tremor_hold": "task_completed phone_held_still sufficient_signal_quality no_excessive_movement",
}
# Reasons of tasks whose factors do not name one reason each.
MOTOR_REASONS = {
    "walking": _errs(
        ("NOT s", "no_sensor"), ("d < 25", "short"), ("n <= 10", "few_steps"), ("NOT coalesce(c BETWEEN 30 AND 200, FALSE)", "cadence_out_of_range"), ("NOT coalesce(r >= 0.3::DOUBLE, FALSE)", "irregular")
    ),
    "tremor_hold": _errs(
        ("d < 8", "short"), ("a > 2", "moved"), ("a IS NULL", "no_amplitude"), ("NOT coalesce(n >= 50 AND ok, FALSE)", "weak_signal"), ("NOT coalesce(a <= 5, FALSE)", "artifact")
    ),
}

for _task, (_view, _parts) in MOTOR.items():
    query(f"C10_motor_quality_{_task}", _quality_sql(_view, _parts, 2, MOTOR_REASONS.get(_task)))(lambda spark, sf, t=_task: _motor(spark, sf, t).select(*Q))
    query(f"C10_motor_breakdown_{_task}", _breakdown_sql(_view, _points(_parts, MOTOR_FACTORS[_task])))(lambda spark, sf, t=_task: _motor(spark, sf, t).select("event_id", "breakdown.*"))


def _part(x: str, full: float, floor: float, w: float) -> str:
    return f"CASE WHEN {x} >= {full}::DOUBLE THEN {w}::DOUBLE WHEN {x} >= {floor}::DOUBLE THEN {rn(f'({x}/{full}::DOUBLE*{w}::DOUBLE)', 2)} ELSE 0e0 END"


VISUAL = """SELECT event_id, k/1e2 AS face, value/1e2 AS light, (100-k)/1e2 AS sure,
  value/CASE WHEN k < 30 THEN 2e1 WHEN k < 60 THEN 3e1 ELSE 2.5e1 END AS done, k/1e3 AS head FROM sessions"""
VISUAL_FACTORS = [
    ("face_detected", _part("face", 0.85, 0.5, 0.3)),
    ("good_lighting", _part("light", 0.8, 0.5, 0.2)),
    ("tracking_confidence", _part("sure", 0.7, 0.4, 0.2)),
    ("task_completed", _part("done", 0.85, 0.5, 0.2)),
    ("head_stability", "CASE WHEN head <= 0.05::DOUBLE THEN 0.1::DOUBLE WHEN head <= 0.12::DOUBLE THEN 0.05::DOUBLE ELSE 0e0 END"),
]


@query(
    "C11_visual_quality",
    f"""WITH {SESSIONS}, v AS ({VISUAL}),
t AS (SELECT *, least(greatest({" + ".join(points for _, points in VISUAL_FACTORS)}, 0e0), 1e0) AS total FROM v)
SELECT event_id, {rn("total", 2)} AS quality, {rn("total", 2)} >= 0.5 AS baseline_eligible,
  {_errs(("face < 0.85::DOUBLE", "face"), ("light < 0.8::DOUBLE", "lighting"), ("sure < 0.7::DOUBLE", "confidence"), ("done < 0.85::DOUBLE", "incomplete"), ("head > 0.05::DOUBLE", "head_motion"))} AS rejection_reasons FROM t""",
)
def visual_quality(spark, sf):
    return _visual(spark, sf).select(*Q)


@query("C11_visual_breakdown", _breakdown_sql(VISUAL, VISUAL_FACTORS))
def visual_breakdown(spark, sf):
    return _visual(spark, sf).select("event_id", "breakdown.*")


def _visual(spark, sf):
    k, v = F.col("k"), F.col("value")
    src = tb.sessions(spark, sf).select(
        "event_id",
        F.when(k < 30, "tracking").when(k < 60, "blink").otherwise("reaction").alias("task_type"),
        (k / 100.0).alias("face_detected_ratio"),
        (v / 100.0).alias("good_lighting_ratio"),
        ((100 - k) / 100.0).alias("mean_confidence"),
        v.alias("duration"),
        (k / 1000.0).alias("head_displacement"),
    )
    return pj.visual_quality(src)


@query(
    "C12_session_quality",
    f"""WITH {SESSIONS}, v AS (SELECT event_id, CASE WHEN k >= 70 THEN k/8e1 END AS q, CASE WHEN k BETWEEN 40 AND 69 THEN value END AS s, CASE WHEN k >= 10 THEN k/1e2 END AS g FROM sessions)
SELECT event_id, least(greatest(coalesce(q, CASE WHEN s > 1 THEN s/1e2 ELSE s END, g, 0e0), 0e0), 1e0) AS effective_quality FROM v""",
)
def session_quality(spark, sf):
    from driftwell.operators.daily import session_quality as effective

    k, v = F.col("k"), F.col("value")
    src = tb.sessions(spark, sf).select(
        "event_id", F.when(k >= 70, k / 80.0).alias("quality_score"), F.when(k.between(40, 69), v).alias("score"), F.when(k >= 10, k / 100.0).alias("signal_quality")
    )
    return src.select("event_id", effective(src).alias("effective_quality"))


@query("C13_baseline_band", f"WITH {baseline_ctes()} SELECT participant_id, {rn('(baseline_mean-baseline_std)', 3)} AS band_low, {rn('(baseline_mean+baseline_std)', 3)} AS band_high FROM baseline")
def band(spark, sf):
    return pj.baseline_band(tb.baselines(tb.hub(spark, sf))).select("participant_id", "band_low", "band_high")


@query(
    "C14_adherence",
    f"""WITH {SESSIONS}, d AS (SELECT participant_id, count(DISTINCT date) AS done, date_diff('day', min(date), max(date)) + 1 AS total FROM sessions WHERE k >= 30 GROUP BY ALL),
p AS (SELECT *, least(CAST(100 AS BIGINT), CAST(floor(done/CAST(greatest(total, 1) AS DOUBLE)*1e2+0.5) AS BIGINT)) AS adherence_pct FROM d)
SELECT *, adherence_pct >= 70 AS target_met FROM p""",
)
def adherence(spark, sf):
    d = tb.sessions(spark, sf).where("k >= 30").groupBy("participant_id").agg(
        F.count_distinct("date").alias("done"), (F.date_diff(F.max("date"), F.min("date")) + 1).alias("total")
    )
    return pj.adherence(d, "done", "total")


@query(
    "C15_risk_pattern",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice/4e5 END AS score FROM orders), c AS (SELECT *, least(greatest(score, 0e0), 1e0) AS x FROM s)
SELECT o_orderkey, CASE WHEN score IS NULL THEN 'within_baseline' WHEN x >= 0.65::DOUBLE THEN 'elevated' WHEN x >= 0.4::DOUBLE THEN 'moderate' ELSE 'within_baseline' END AS dashboard_pattern,
  CASE WHEN score IS NULL THEN 'incomplete' WHEN """ + r4("x") + """ >= 0.5 THEN 'elevated' ELSE 'standard' END AS log_pattern FROM c""",
)
def risk_pattern(spark, sf):
    o = tb.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 4e5).alias("score"))
    return pj.risk_pattern(o, "score").drop("score")


@query("C16_pseudonymize", "SELECT c_custkey, 'ps_' || substr(sha256(c_name || ':study-7'), 1, 24) AS pseudonymous_id FROM customer")
def pseudonymize(spark, sf):
    return pj.pseudonymize(tb.table(spark, sf, "customer"), "c_name", "study-7").select("c_custkey", "pseudonymous_id")


@query(
    "C17_idempotency_key",
    "SELECT event_id, 'idmp_' || substr(sha256(event_id || '_' || user_id || '_' || epoch_us(ts)), 1, 32) AS idempotency_key FROM events",
)
def idempotency(spark, sf):
    ev = tb.table(spark, sf, "events")
    return ev.select("event_id", pj.idempotency_key(F.col("event_id"), F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp"))).alias("idempotency_key"))


@query(
    "C18_bump_patch",
    "SELECT event_id, CASE WHEN k < 20 THEN '1.0.1' ELSE '2.' || k || '.' || (k + 1) END AS version FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)",
)
def bump_patch(spark, sf):
    s = tb.sessions(spark, sf)
    v = F.when(F.col("k") < 10, None).when(F.col("k") < 20, "x.y.z").otherwise(F.concat_ws(".", F.lit("2"), F.col("k").cast("string"), F.col("k").cast("string")))
    return s.select("event_id", bl.bump_patch(v).alias("version"))
