"""F: personal baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions.numeric import round4
from driftwell.operators import baseline as bl
from driftwell.operators import daily as dy
from driftwell.plans import tables as tb
from driftwell.plans.daily_queries import DAY_SQL, _day_cols
from driftwell.plans.registry import query
from driftwell.plans.sqltext import HUB, HUB_BY_MODALITY, baseline_ctes, r4, rn

AFTER = f"date > DATE '{tb.CALIBRATION_END}'"
STATS_COLS = "baseline_mean, baseline_median, baseline_std, q1, q3, iqr, baseline_mad, coefficient_of_variation, CAST(sample_count AS BIGINT) AS sample_count"


@query(
    "F1_feature_series",
    f"""WITH {DAY_SQL},
d AS (SELECT * FROM tracked JOIN quality USING (participant_id, date) LEFT JOIN feat USING (participant_id, date))
SELECT participant_id, CAST(date AS VARCHAR) AS date, modality, feature_name, value, quality_score FROM (
"""
    + " UNION ALL ".join(
        f"SELECT participant_id, date, '{m}' AS modality, '{f}' AS feature_name, {m}__{f} AS value, "
        f"{'1e0' if m == 'sleep' else f'coalesce({m}_quality, 1e0)'} AS quality_score FROM d WHERE contains(available_modalities, '{m}')\n"
        for m, f in _day_cols
    )
    + ") WHERE value IS NOT NULL AND quality_score >= 0.5",
)
def feature_series(spark, sf):
    return bl.feature_series(dy.daily_vector(tb.feature_sessions(spark, sf)))


@query("F2_baseline_stats", f"WITH {baseline_ctes()} SELECT participant_id, {STATS_COLS} FROM baseline")
def baseline_stats(spark, sf):
    h = bl.in_period(tb.hub(spark, sf), end=tb.CALIBRATION_END)
    return bl.baseline_stats(h).drop("modality", "feature_name", "baseline_start_date", "baseline_end_date")


@query("F3_mad", f"WITH {baseline_ctes(HUB_BY_MODALITY, 'TRUE')} SELECT participant_id, modality, feature_name, baseline_mad FROM baseline")
def mad(spark, sf):
    return bl.mad(tb.hub(spark, sf, overall=False))


ROW_COLS = f"""participant_id, modality, feature_name, {STATS_COLS}, lower_bound, upper_bound, baseline_status,
  '1.0.0' AS baseline_version, '1.0.0' AS algorithm_version, CAST(baseline_start_date AS VARCHAR) AS baseline_start_date,
  CAST(baseline_end_date AS VARCHAR) AS baseline_end_date"""


@query("F4_baseline_row", f"WITH {baseline_ctes()} SELECT {ROW_COLS} FROM baseline")
def baseline_row(spark, sf):
    return tb.baselines(tb.hub(spark, sf))


@query(
    "F5_establish_summary",
    f"""WITH {baseline_ctes(HUB_BY_MODALITY, "TRUE", 5)},
s AS (SELECT participant_id, count(*) AS total_features, count(*) FILTER (baseline_status = 'established') AS established_features
      FROM baseline GROUP BY ALL)
SELECT *, CASE WHEN established_features > 0 AND established_features = total_features THEN 'established' ELSE 'calibrating' END AS overall_status
FROM s""",
)
def establish_summary(spark, sf):
    return bl.establish(tb.hub(spark, sf, overall=False), min_days=5)[1]


@query(
    "F6_effective_dispersion",
    f"WITH {baseline_ctes(HUB_BY_MODALITY, 'TRUE')} SELECT participant_id, modality, disp AS effective_dispersion FROM baseline",
)
def effective_dispersion(spark, sf):
    b = bl.baseline_row(tb.hub(spark, sf, overall=False))
    return b.select(
        "participant_id",
        "modality",
        bl.effective_dispersion(F.col("baseline_mad"), F.col("baseline_std")).alias("effective_dispersion"),
    )


DIST = r4("(abs(h.value-b.baseline_median)/b.disp)")
OUTLIER = f"""obs AS (
  SELECT h.*, b.baseline_median, b.disp, {DIST} AS mad_distance, coalesce({DIST} > 3, FALSE) AS is_outlier
  FROM hub h LEFT JOIN baseline b USING (participant_id, modality, feature_name) WHERE {AFTER})"""


@query(
    "F7_detect_outliers",
    f"""WITH {baseline_ctes()}, {OUTLIER}
SELECT participant_id, CAST(date AS VARCHAR) AS date, value, mad_distance, is_outlier,
       CASE WHEN is_outlier THEN 'anomalous observation' END AS anomaly_flag
FROM obs""",
)
def detect_outliers(spark, sf):
    h, b = tb.calibrated(spark, sf)
    out = bl.detect_outliers(h.where(AFTER), b)
    return out.select("participant_id", "date", "value", "mad_distance", "is_outlier", "anomaly_flag")


@query(
    "F8_robust_deviation",
    f"""WITH {baseline_ctes()}, {OUTLIER},
r AS (SELECT *, coalesce(baseline_median, value) AS med, coalesce(disp, 0.001::DOUBLE) AS width FROM obs)
SELECT participant_id, modality, feature_name, CAST(date AS VARCHAR) AS date, value, med AS baseline_value,
       {r4("((value-med)/(width*1.4826::DOUBLE))")} AS deviation_score, {r4("(value-med)")} AS trend_score,
       quality_score, is_outlier, CASE WHEN is_outlier THEN 'anomalous observation' END AS anomaly_flag, mad_distance,
       CASE WHEN is_outlier THEN 'Recent measurement differs notably from personal baseline (anomalous observation).'
            ELSE 'Measurement consistent with personal baseline.' END AS summary_text
FROM r""",
)
def robust_deviation(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return bl.robust_deviation(h.where(AFTER), b)


_DISP = f"CASE WHEN s.mad > 0 THEN s.mad WHEN s.std > 0 THEN {r4('(s.std*0.6745::DOUBLE)')} ELSE 0.001::DOUBLE END"
_NM = r4("(0.1::DOUBLE*d.v + 0.9::DOUBLE*s.median)")
_NMEAN = r4("(0.1::DOUBLE*d.v + 0.9::DOUBLE*s.mean)")
_SQ = f"sqrt(0.1::DOUBLE*(d.v-{_NMEAN})*(d.v-{_NMEAN}) + 0.9::DOUBLE*s.std*s.std)"
_MADN = f"(0.1::DOUBLE*abs(d.v-{_NM}) + 0.9::DOUBLE*s.mad)"
ADAPTIVE = f"""{baseline_ctes()},
days AS (SELECT participant_id, date, value AS v, quality_score AS q, row_number() OVER (PARTITION BY participant_id ORDER BY date) AS i
         FROM hub WHERE {AFTER}),
fold AS (
  WITH RECURSIVE f(participant_id, i, mean, median, std, mad, n, lowq, outl) AS (
    SELECT participant_id, CAST(0 AS BIGINT), baseline_mean, baseline_median, baseline_std, baseline_mad, CAST(sample_count AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM baseline
    UNION ALL
    SELECT x.participant_id, x.i,
           CASE WHEN kind = 'u' THEN nmean ELSE mean END, CASE WHEN kind = 'u' THEN nmed ELSE median END,
           CASE WHEN kind = 'u' THEN {r4("nsd")} ELSE std END, CASE WHEN kind = 'u' THEN {r4("nmad")} ELSE mad END,
           CASE WHEN kind = 'u' THEN n + 1 ELSE n END, CASE WHEN kind = 'l' THEN lowq + 1 ELSE lowq END,
           CASE WHEN kind = 'o' THEN outl + 1 ELSE outl END
    FROM (
      SELECT s.*  EXCLUDE (i), d.i, d.v, {_NMEAN} AS nmean, {_NM} AS nmed, {_SQ} AS nsd, {_MADN} AS nmad,
             CASE WHEN d.q < 0.5 THEN 'l' WHEN {r4(f"(abs(d.v-s.median)/({_DISP}))")} > 3 THEN 'o' ELSE 'u' END AS kind
      FROM f s JOIN days d ON d.participant_id = s.participant_id AND d.i = s.i + 1) x)
  SELECT * FROM f),
last AS (SELECT f.*, CASE WHEN mad > 0 THEN mad WHEN std > 0 THEN std ELSE 0.001::DOUBLE END AS u
         FROM fold f QUALIFY row_number() OVER (PARTITION BY f.participant_id ORDER BY i DESC) = 1),
every AS (SELECT l.*, b.sample_count AS n0 FROM last l JOIN baseline b USING (participant_id)),
folded AS (SELECT * FROM every WHERE i > 0)"""


@query(
    "F9_adaptive_baseline",
    f"""WITH {ADAPTIVE}
SELECT participant_id, 'all' AS modality, 'value' AS feature_name, mean AS baseline_mean, median AS baseline_median, std AS baseline_std, mad AS baseline_mad,
       {r4("(median-0.6745::DOUBLE*u)")} AS q1, {r4("(median+0.6745::DOUBLE*u)")} AS q3,
       CASE WHEN mean <> 0 THEN abs({r4("(std/mean)")}) ELSE 0e0 END AS coefficient_of_variation,
       {r4("(median-3*u)")} AS lower_bound, {r4("(median+3*u)")} AS upper_bound,
       '1.0.' || CAST(n - n0 AS VARCHAR) AS baseline_version, n AS sample_count, lowq AS rejected_low_quality, outl AS rejected_outlier
FROM every WHERE n0 > 0""",
)
def adaptive_baseline(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return bl.adaptive_baseline(h.where(AFTER), b)


@query(
    "F10_baseline_version",
    f"""WITH {baseline_ctes()}
SELECT participant_id, modality, feature_name, '1.0.1' AS baseline_version, '1.0.0' AS algorithm_version,
       CAST(sample_count + 1 AS BIGINT) AS sample_count
FROM baseline""",
)
def baseline_version(spark, sf):
    b = tb.baselines(tb.hub(spark, sf))
    return bl.baseline_version(b).select(*bl.SERIES, "baseline_version", "algorithm_version", "sample_count")


NEXT_DAY = "date = DATE '2024-01-21'"
PROCESS = f"""{baseline_ctes()},
p0 AS (
  SELECT h.participant_id, h.date, h.value AS v, h.quality_score AS q, b.baseline_mean AS mean, b.baseline_median AS median,
         b.baseline_std AS std, b.baseline_mad AS mad,
         CASE WHEN h.quality_score < 0.5 THEN 'rejected_low_quality' WHEN {DIST} > 3 THEN 'rejected_outlier' ELSE 'updated' END AS status
  FROM hub h JOIN baseline b USING (participant_id, modality, feature_name) WHERE h.{NEXT_DAY})"""


@query(
    "F11_process_day",
    f"""WITH {PROCESS},
p1 AS (SELECT d.*, {_NMEAN.replace('s.', 'd.')} AS nmean, {_NM.replace('s.', 'd.')} AS nmed FROM p0 d)
SELECT participant_id, CAST(date AS VARCHAR) AS date, status, v AS value,
       CASE WHEN status = 'updated' THEN nmean ELSE mean END AS new_mean,
       CASE WHEN status = 'updated' THEN nmed ELSE median END AS new_median,
       CASE WHEN status = 'updated' THEN {r4("sqrt(0.1::DOUBLE*(v-nmean)*(v-nmean) + 0.9::DOUBLE*std*std)")} ELSE std END AS new_std,
       CASE WHEN status = 'updated' THEN {r4("(0.1::DOUBLE*abs(v-nmed) + 0.9::DOUBLE*mad)")} ELSE mad END AS new_mad
FROM p1""",
)
def process_day(spark, sf):
    h, b = tb.calibrated(spark, sf)
    out = bl.process_day(h.where(NEXT_DAY), b)
    return out.select("participant_id", "date", "status", "value", "new_mean", "new_median", "new_std", "new_mad")


# The whole next row: p3 holds the moved values, kept ones come from the baseline.
NEXT_ROW = f"""{PROCESS},
p1 AS (SELECT d.*, {_NMEAN.replace('s.', 'd.')} AS nmean, {_NM.replace('s.', 'd.')} AS nmed FROM p0 d),
p2 AS (SELECT *, {r4("sqrt(0.1::DOUBLE*(v-nmean)*(v-nmean) + 0.9::DOUBLE*std*std)")} AS nsd,
              {r4("(0.1::DOUBLE*abs(v-nmed) + 0.9::DOUBLE*mad)")} AS nmad, status = 'updated' AS up FROM p1),
p3 AS (SELECT *, CASE WHEN nmad > 0 THEN nmad WHEN nsd > 0 THEN nsd ELSE 0.001::DOUBLE END AS u FROM p2)"""


@query(
    "F11_updated_baselines",
    f"""WITH {NEXT_ROW}
SELECT participant_id, b.modality, b.feature_name, CASE WHEN up THEN nmean ELSE mean END AS baseline_mean, CASE WHEN up THEN nmed ELSE median END AS baseline_median,
       CASE WHEN up THEN nsd ELSE std END AS baseline_std, CASE WHEN up THEN nmad ELSE mad END AS baseline_mad,
       CASE WHEN up THEN {r4("(nmed-0.6745::DOUBLE*u)")} ELSE b.q1 END AS q1, CASE WHEN up THEN {r4("(nmed+0.6745::DOUBLE*u)")} ELSE b.q3 END AS q3, b.iqr,
       CASE WHEN NOT up THEN b.coefficient_of_variation WHEN nmean <> 0 THEN abs({r4("(nsd/nmean)")}) ELSE 0e0 END AS coefficient_of_variation,
       CASE WHEN up THEN {r4("(nmed-3*u)")} ELSE b.lower_bound END AS lower_bound, CASE WHEN up THEN {r4("(nmed+3*u)")} ELSE b.upper_bound END AS upper_bound,
       CASE WHEN up THEN 'adaptive_updated' ELSE b.baseline_status END AS baseline_status, CASE WHEN up THEN '1.0.1' ELSE '1.0.0' END AS baseline_version,
       CAST(b.sample_count + CASE WHEN up THEN 1 ELSE 0 END AS BIGINT) AS sample_count, '1.0.0' AS algorithm_version,
       CAST(b.baseline_start_date AS VARCHAR) AS baseline_start_date, CAST(b.baseline_end_date AS VARCHAR) AS baseline_end_date,
       CASE WHEN up THEN CAST(p3.date AS VARCHAR) END AS baseline_updated_at
FROM p3 JOIN baseline b USING (participant_id)""",
)
def updated_baselines(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return bl.updated_baselines(bl.process_day(h.where(NEXT_DAY), b))


@query(
    "F11_day_deviations",
    f"""WITH {PROCESS}, r AS (SELECT p0.*, b.modality, b.feature_name, b.disp, {r4("(abs(v-median)/b.disp)")} AS mad_distance FROM p0 JOIN baseline b USING (participant_id) WHERE status <> 'rejected_low_quality')
SELECT participant_id, modality, feature_name, CAST(date AS VARCHAR) AS date, v AS value, median AS baseline_value,
       {r4("((v-median)/(disp*1.4826::DOUBLE))")} AS deviation_score, {r4("(v-median)")} AS trend_score, q AS quality_score,
       status = 'rejected_outlier' AS is_outlier, CASE WHEN status = 'rejected_outlier' THEN 'anomalous observation' END AS anomaly_flag, mad_distance,
       CASE WHEN status = 'rejected_outlier' THEN 'Recent measurement differs notably from personal baseline (anomalous observation).'
            ELSE 'Measurement consistent with personal baseline.' END AS summary_text
FROM r""",
)
def day_deviations(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return bl.day_deviations(bl.process_day(h.where(NEXT_DAY), b))


@query(
    "F11_day_counters",
    f"""WITH {PROCESS}
SELECT participant_id, CAST(date AS VARCHAR) AS date, count(*) AS total_evaluated, count(*) FILTER (status = 'updated') AS updated_count,
       count(*) FILTER (status = 'rejected_outlier') AS rejected_outlier_count, bool_or(status = 'rejected_outlier') AS has_anomalies
FROM p0 GROUP BY participant_id, date""",
)
def day_counters(spark, sf):
    h, b = tb.calibrated(spark, sf)
    return bl.day_counters(bl.process_day(h.where(NEXT_DAY), b))


@query(
    "F12_deviation_distance",
    f"""WITH {baseline_ctes(HUB_BY_MODALITY)},
z AS (SELECT h.participant_id, h.date, h.modality || '.' || h.feature_name AS name,
             CASE WHEN b.baseline_std > 0 THEN (h.value-b.baseline_mean)/b.baseline_std END AS z
      FROM hub h JOIN baseline b USING (participant_id, modality, feature_name) WHERE {AFTER}),
a AS (SELECT participant_id, date, coalesce(sum(z*z), 0e0) AS sq, count(z) AS k,
             coalesce(string_agg(CASE WHEN abs(z) >= 2 THEN name END, '|' ORDER BY name), '') AS significant_deviations
      FROM z GROUP BY ALL)
SELECT participant_id, CAST(date AS VARCHAR) AS date, k, significant_deviations,
       {rn("sqrt(sq/greatest(k,1))", 3)} AS distance, significant_deviations <> '' AS is_significant
FROM a""",
)
def deviation_distance(spark, sf):
    h, b = tb.calibrated(spark, sf, overall=False)
    return bl.deviation_distance(h.where(AFTER), b)
