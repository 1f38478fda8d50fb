"""G: deviation, sustained runs and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions.numeric import round4
from driftwell.operators import trend as tr
from driftwell.plans import tables as tb
from driftwell.plans.registry import query
from driftwell.plans.sqltext import DEVIATION_LABEL, HUB, HUB_BY_MODALITY, SESSIONS, exact, r4, rn, zscore_ctes

KEYS = "PARTITION BY participant_id, modality, feature_name ORDER BY date"
Z = zscore_ctes()
ZM = zscore_ctes(HUB_BY_MODALITY)
DATE = "CAST(date AS VARCHAR) AS date"


def _dev(spark, sf, overall=True):
    h, b = tb.calibrated(spark, sf, overall)
    return tr.deviation(h, b)


@query("G1_deviation", f"WITH {ZM} SELECT participant_id, modality, {DATE}, value, z_score, method FROM dev")
def deviation(spark, sf):
    return _dev(spark, sf, False).select("participant_id", "modality", "date", "value", "z_score", "method")


@query(
    "G2_deviation_record",
    f"""WITH {ZM}
SELECT participant_id, {DATE}, modality, feature_name, value,
       coalesce(CASE WHEN method = 'parametric_std' THEN baseline_mean WHEN method = 'missing_baseline' THEN NULL ELSE baseline_median END, 0e0) AS baseline_value,
       coalesce(z_score, 0e0) AS deviation_score, 0e0 AS trend_score, quality_score, '1.1.0' AS algorithm_version
FROM dev""",
)
def deviation_record(spark, sf):
    return tr.deviation_record(_dev(spark, sf, False))


@query(
    "G3_deviation_labels",
    f"""WITH {Z}
SELECT participant_id, {DATE}, value, z_score, {DEVIATION_LABEL} AS label,
       CAST(CASE WHEN z_score IS NULL OR abs(z_score) < 1.5 THEN 0 WHEN abs(z_score) < 2 THEN 1 WHEN abs(z_score) < 3 THEN 2 ELSE 3 END AS BIGINT) AS severity
FROM dev""",
)
def deviation_labels(spark, sf):
    return tr.classify(_dev(spark, sf)).select("participant_id", "date", "value", "z_score", "label", "severity")


STREAK = """hi AS (SELECT *, coalesce(abs(z_score) > {t}, FALSE) AS high, row_number() OVER ({k}) AS i FROM dev),
streaks AS (SELECT *, i - coalesce(max(CASE WHEN NOT high THEN i END) OVER ({k} ROWS UNBOUNDED PRECEDING), 0) AS streak FROM hi)"""


@query(
    "G3_sustained_labels",
    f"""WITH {ZM}, {STREAK.format(t=2, k=KEYS)}
SELECT participant_id, modality, {DATE}, z_score, streak,
       CASE WHEN abs(z_score) > 2 AND streak >= 5 THEN 'Sustained deviation detected' ELSE {DEVIATION_LABEL} END AS label
FROM streaks""",
)
def sustained_labels(spark, sf):
    out = tr.classify(tr.running_streak(_dev(spark, sf, False)), "streak")
    return out.select("participant_id", "modality", "date", "z_score", "streak", "label")


@query(
    "G3_plain_severity",
    f"""WITH {Z}, p AS (SELECT *, CASE WHEN baseline_std > 0 THEN (value-baseline_mean)/baseline_std ELSE 0e0 END AS zz FROM dev)
SELECT participant_id, {DATE}, {rn("zz", 3)} AS z3,
       CASE WHEN abs(zz) >= 3 THEN 'significant' WHEN abs(zz) >= 2 THEN 'moderate' WHEN abs(zz) >= 1.5 THEN 'mild' ELSE 'normal' END AS severity
FROM p""",
)
def plain_severity(spark, sf):
    z, word = tr.classify_plain(F.col("value"), F.col("baseline_mean"), F.col("baseline_std"))
    return _dev(spark, sf).select("participant_id", "date", z.alias("z3"), word.alias("severity"))


# A lower threshold than the default gives runs on the given data; the default is exercised in the tests.
@query(
    "G4_current_streak",
    f"""WITH {Z}, {STREAK.format(t='0.3::DOUBLE', k=KEYS)}
SELECT participant_id, modality, feature_name, streak AS consecutive_days, streak >= 5 AS is_sustained FROM streaks
QUALIFY row_number() OVER ({KEYS} DESC) = 1""",
)
def current_streak(spark, sf):
    return tr.current_streak(_dev(spark, sf), threshold=0.3)


@query(
    "G5_sustained_runs",
    f"""WITH {Z}, {STREAK.format(t='0.3::DOUBLE', k=KEYS)},
runs AS (SELECT participant_id, modality, feature_name, i - streak AS g, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days
         FROM streaks WHERE high GROUP BY ALL)
SELECT participant_id, modality, feature_name, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, duration_days
FROM runs WHERE duration_days >= 5""",
)
def sustained_runs(spark, sf):
    return tr.sustained_runs(_dev(spark, sf), threshold=0.3)


@query(
    "G5_max_streak",
    f"""WITH {Z}, {STREAK.format(t='0.3::DOUBLE', k=KEYS)}
SELECT participant_id, modality, feature_name, max(streak) AS max_streak FROM streaks GROUP BY ALL""",
)
def max_streak(spark, sf):
    return tr.max_streak(_dev(spark, sf), threshold=0.3)


W7, W14 = f"({KEYS} ROWS 6 PRECEDING)", f"({KEYS} ROWS 13 PRECEDING)"


def _rolling(src: str) -> str:
    mean7, q7 = f"{exact('value', f' OVER {W7}')}/count(value) OVER {W7}", f"{exact('quality_score', f' OVER {W7}')}/count(quality_score) OVER {W7}"
    return f"""w0 AS (SELECT *, row_number() OVER ({KEYS}) AS rn FROM {src}),
w1 AS (SELECT *, {mean7} AS m7, count(value) OVER {W7} AS n7, stddev_samp(value) OVER {W7} AS s7, {q7} AS q7,
       count(value) OVER {W14} AS n14, sum(CASE WHEN value IS NOT NULL THEN rn END) OVER {W14} AS sx, {exact('value', f' OVER {W14}')} AS sy,
       {exact('rn*value', f' OVER {W14}')} AS sxy, sum(CASE WHEN value IS NOT NULL THEN rn*rn END) OVER {W14} AS sxx
  FROM w0),
w2 AS (SELECT *, CASE WHEN n7 > 0 THEN {r4("m7")} END AS seven_day_average,
       CASE WHEN n7 = 1 THEN 0e0 WHEN n7 > 1 THEN {r4("s7")} END AS seven_day_variability,
       coalesce(least(greatest({r4("q7")}, 0e0), 1e0), 0e0) AS data_quality,
       CASE WHEN n14 >= 2 AND n14*sxx-sx*sx <> 0 THEN {r4("(CAST(n14*sxy-sx*sy AS DOUBLE)/CAST(n14*sxx-sx*sx AS DOUBLE))")} ELSE 0e0 END AS fourteen_day_trend,
       {r4("((14-n14)/14e0)")} AS missingness
  FROM w1)"""


@query(
    "G6_rolling7",
    f"""WITH {HUB_BY_MODALITY}, {_rolling("hub")}
SELECT participant_id, modality, {DATE}, value, seven_day_average, seven_day_variability, data_quality FROM w2""",
)
def rolling7(spark, sf):
    return tr.rolling7(tb.hub(spark, sf, False)).drop("feature_name", "quality_score", "n_sessions")


DENSE = f"""{HUB},
span AS (SELECT participant_id, modality, feature_name, min(date) AS a, max(date) AS b FROM hub GROUP BY ALL),
spine AS (SELECT participant_id, modality, feature_name, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
dense AS (SELECT s.*, h.value, h.quality_score FROM spine s LEFT JOIN hub h USING (participant_id, modality, feature_name, date))"""


@query("G7_slope14", f"""WITH {DENSE}, {_rolling("dense")} SELECT participant_id, {DATE}, value, fourteen_day_trend FROM w2""")
def slope14(spark, sf):
    dense = tr.densify(tb.hub(spark, sf).drop("n_sessions"))
    return tr.slope14(dense).select("participant_id", "date", "value", "fourteen_day_trend")


@query("G8_missingness14", f"""WITH {DENSE}, {_rolling("dense")} SELECT participant_id, {DATE}, missingness FROM w2""")
def missingness14(spark, sf):
    dense = tr.densify(tb.hub(spark, sf).drop("n_sessions"))
    return tr.missingness14(dense).select("participant_id", "date", "missingness")


TREND = """CASE WHEN abs(fourteen_day_trend) < 0.01::DOUBLE THEN 'Stable within baseline'
  WHEN (value-centre >= 0 AND fourteen_day_trend > 0) OR (value-centre < 0 AND fourteen_day_trend < 0) THEN 'Progressive deviation from personal baseline'
  WHEN (value-centre > 0 AND fourteen_day_trend < 0) OR (value-centre < 0 AND fourteen_day_trend > 0) THEN 'Improving toward baseline'
  ELSE 'Stable within baseline' END"""
LONGITUDINAL = f"""{Z}, {_rolling("dev")},
lab AS (SELECT *, coalesce(baseline_mean, baseline_median, value) AS centre, coalesce(abs(z_score) > 2, FALSE) AS high FROM w2),
fin AS (SELECT *, least(rn - coalesce(max(CASE WHEN NOT high THEN rn END) OVER ({KEYS} ROWS UNBOUNDED PRECEDING), 0), 14) AS sustained_deviation FROM lab)"""


@query(
    "G9_trend_label",
    f"WITH {LONGITUDINAL} SELECT trend_label, count(*) AS n FROM (SELECT {TREND} AS trend_label FROM fin) GROUP BY ALL",
)
def trend_label(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return tr.longitudinal(h, b).groupBy("trend_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "G10_longitudinal",
    f"""WITH {LONGITUDINAL}
SELECT participant_id, modality, feature_name, {DATE}, value AS daily_value, seven_day_average, seven_day_variability, fourteen_day_trend,
       z_score AS baseline_deviation, CAST(sustained_deviation AS BIGINT) AS sustained_deviation, missingness, data_quality, {TREND} AS trend_label
FROM fin""",
)
def longitudinal(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return tr.longitudinal(h, b)


AS_OF = "2024-01-28 12:00:00"


def _sleep(spark, sf):
    s = tb.sessions(spark, sf).where("modality = 'sleep'")
    return s.select("participant_id", F.col("ts").alias("timestamp"), (F.col("k") >= 60).alias("unusual_movement_self_report"))


@query(
    "G11_concern_window",
    f"""WITH {SESSIONS},
w AS (SELECT participant_id, date, k >= 60 AS yes FROM sessions WHERE modality = 'sleep' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS),
c AS (SELECT participant_id, count(DISTINCT CASE WHEN yes THEN date END) AS positive_days, count(*) AS evaluated_sessions FROM w GROUP BY ALL)
SELECT *, positive_days >= 2 AS flagged FROM c""",
)
def concern_window(spark, sf):
    return tr.concern_window(_sleep(spark, sf), AS_OF)


@query(
    "G11_rolling_concern",
    f"""WITH {SESSIONS},
d AS (SELECT participant_id, date, max(CAST(k >= 60 AS BIGINT)) AS positive FROM sessions WHERE modality = 'sleep' GROUP BY ALL),
r AS (SELECT participant_id, date, positive, CAST(sum(positive) OVER (PARTITION BY participant_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS positive_days FROM d)
SELECT participant_id, {DATE}, positive, positive_days, positive_days >= 2 AS flagged FROM r""",
)
def rolling_concern(spark, sf):
    return tr.rolling_concern(_sleep(spark, sf))
