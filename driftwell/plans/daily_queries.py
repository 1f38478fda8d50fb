"""E: daily aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.functions.numeric import round4
from driftwell.operators import daily as dy
from driftwell.plans import tables as tb
from driftwell.plans.registry import query
from driftwell.plans.sqltext import SESSIONS, exact, mdn, med, r4, rn

STATUS = f"""{SESSIONS},
st AS (
  SELECT participant_id, date, modality, count(*) AS total_count,
         count(*) FILTER (quality_score >= 0.5) AS passed_count,
         {mdn('quality_score', ' FILTER (quality_score >= 0.5)')} AS ok_u,
         {mdn('quality_score', ' FILTER (quality_score < 0.5)')} AS low_u
  FROM sessions GROUP BY ALL),
status AS (
  SELECT participant_id, date, modality, CASE WHEN passed_count > 0 THEN 'valid' ELSE 'low_quality' END AS status,
         {r4("coalesce(ok_u, low_u)")} AS quality_score, passed_count, total_count,
         total_count - passed_count AS rejected_count
  FROM st)"""

_listed = {
    "available_modalities": "= 'valid'",
    "missing_modalities": "IS DISTINCT FROM 'valid'",
    "low_quality_modalities": "= 'low_quality'",
}
_flags = ", ".join(f"max(status) FILTER (modality = '{m}') AS s_{m}" for m in fv.MODALITIES)
_arrays = ", ".join(
    f"concat_ws('|', {', '.join(f'CASE WHEN s_{m} {cond} THEN {chr(39)}{m}{chr(39)} END' for m in fv.MODALITIES)}) AS {name}"
    for name, cond in _listed.items()
)
_navail = " + ".join(f"(CASE WHEN s_{m} = 'valid' THEN 1 ELSE 0 END)" for m in fv.MODALITIES)
TRACKED = f"""{STATUS},
flags AS (SELECT participant_id, date, {_flags} FROM status GROUP BY ALL),
tracked AS (SELECT participant_id, date, {_arrays}, {rn(f"(({_navail})/5e0)", 2)} AS completeness_ratio FROM flags)"""

_qs = ", ".join(f"max(quality_score) FILTER (modality = '{m}') AS {m}_quality" for m in fv.QUALITY_TRACKED)
_sum = " + ".join(f"coalesce({m}_quality, 0)" for m in fv.QUALITY_TRACKED)
_cnt = " + ".join(f"(CASE WHEN {m}_quality IS NOT NULL THEN 1 ELSE 0 END)" for m in fv.QUALITY_TRACKED)
QUALITY = f"""q0 AS (SELECT participant_id, date, {_qs} FROM status GROUP BY ALL),
quality AS (SELECT *, CASE WHEN {_cnt} > 0 THEN {r4(f"(({_sum})/({_cnt}))")} ELSE 0e0 END AS overall_quality FROM q0)"""

# Where each roll-up feature comes from in the session view of the given table.
_SOURCE = {
    "typing": ["value", "kk", "hh"],
    "voice": ["value", "kk", "hh", "mm"],
    "motor": ["value", "kk", "hh", "mm"],
    "visual": ["value", "kk", "hh"],
    "sleep": ["hh", "kk", "value"],
}
LONG = f"""{STATUS},
fs AS (SELECT *, CAST(k AS DOUBLE) AS kk, CAST(hour(ts) AS DOUBLE) AS hh, CAST(minute(ts) AS DOUBLE) AS mm
       FROM sessions WHERE quality_score >= 0.5),
long AS (
""" + "  UNION ALL ".join(
    f"SELECT participant_id, date, modality, '{f}' AS feature_name, {src} AS value FROM fs WHERE modality = '{m}'\n"
    for m in fv.MODALITIES
    for f, src in zip(fv.MODALITY_FEATURES[m], _SOURCE[m])
) + ")"

_q1 = "list_sort(arr)[1:len(arr)//2]"
STATS = f"""g0 AS (
  SELECT participant_id, date, modality, feature_name, list_sort(list(CAST(value AS DOUBLE))) AS arr, {exact('value')} AS total, avg(value) AS mean_raw,
         stddev_samp(value) AS sd
  FROM long GROUP BY ALL),
g1 AS (
  SELECT *, len(arr) AS n, arr[1:len(arr)//2] AS lower_half, arr[len(arr)-len(arr)//2+1:len(arr)] AS upper_half,
         total/len(arr) AS mean
  FROM g0),
g2 AS (
  SELECT *, {r4(med("arr"))} AS median,
         CASE WHEN n < 2 THEN 0e0 WHEN n = 2 THEN {r4("(arr[2]-arr[1])")}
              ELSE {r4(f"greatest({r4(med('upper_half'))}-{r4(med('lower_half'))}, 0e0)")} END AS iqr,
         CASE WHEN n > 1 AND mean <> 0 THEN abs(sd/mean) ELSE 0e0 END AS cv
  FROM g1),
g3 AS (
  SELECT *, CASE WHEN median <> 0 THEN abs(iqr/median) ELSE 0e0 END AS iqr_rel,
         CASE WHEN mean <> 0 THEN (arr[n]-arr[1])/abs(mean) ELSE 0e0 END AS range_rel
  FROM g2),
stats AS (
  SELECT *, n >= 2 AND (cv > 0.35::DOUBLE OR iqr_rel > 0.40::DOUBLE OR (n = 2 AND range_rel > 0.5)) AS disagree FROM g3)"""


@query(
    "E1_quality_gate",
    f"""WITH {SESSIONS}
SELECT event_id, quality_score AS effective_quality, quality_score >= 0.5 AS accepted,
       CASE WHEN quality_score < 0.5 THEN 'Quality score ' || printf('%.3f', quality_score) || ' is below minimum threshold 0.5' END AS rejection_reason
FROM sessions""",
)
def quality_gate(spark, sf):
    return dy.quality_gate(tb.sessions(spark, sf)).select("event_id", "effective_quality", "accepted", "rejection_reason")


@query("E2_modality_status", f"WITH {STATUS} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM status")
def modality_status(spark, sf):
    return dy.modality_status(tb.sessions(spark, sf))


_expected = ", ".join(f"('{m}')" for m in fv.MODALITIES)


@query(
    "E2_modality_report",
    f"""WITH {STATUS},
low AS (SELECT participant_id, date, modality, 'Quality score ' || printf('%.3f', quality_score) || ' is below minimum threshold 0.5' AS reason, count(*) AS n
        FROM sessions WHERE quality_score < 0.5 GROUP BY ALL),
why AS (SELECT participant_id, date, modality, string_agg(reason || ' x' || CAST(n AS VARCHAR), '|' ORDER BY reason) AS reasons FROM low GROUP BY ALL),
days AS (SELECT DISTINCT participant_id, date FROM status)
SELECT participant_id, CAST(date AS VARCHAR) AS date, modality, coalesce(s.status, 'missing') AS status, s.quality_score, coalesce(s.passed_count, 0) AS passed_count,
       coalesce(s.total_count, 0) AS total_count, coalesce(s.rejected_count, 0) AS rejected_count,
       CASE WHEN s.status IS NULL THEN 'No sessions recorded for modality on this day. x0' WHEN s.status = 'low_quality' THEN why.reasons ELSE '' END AS reasons
FROM days CROSS JOIN (VALUES {_expected}) AS m(modality) LEFT JOIN status s USING (participant_id, date, modality) LEFT JOIN why USING (participant_id, date, modality)""",
)
def modality_report(spark, sf):
    listed = F.transform("reasons", lambda r: F.concat(r["reason"], F.lit(" x"), r["sessions"].cast("string")))
    return dy.modality_report(tb.sessions(spark, sf)).withColumn("reasons", listed)


@query("E3_missingness", f"WITH {TRACKED} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM tracked")
def missingness(spark, sf):
    return dy.missingness_tracker(dy.modality_status(tb.sessions(spark, sf)))


@query("E4_overall_quality", f"WITH {STATUS}, {QUALITY} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM quality")
def overall_quality(spark, sf):
    return dy.overall_quality(dy.modality_status(tb.sessions(spark, sf)))


@query(
    "E5_daily_median",
    f"""WITH {SESSIONS}
SELECT participant_id, modality, CAST(date AS VARCHAR) AS date, {r4(mdn("value"))} AS value, count(*) AS n_sessions
FROM sessions WHERE quality_score >= 0.5 GROUP BY ALL""",
)
def daily_median(spark, sf):
    s = tb.sessions(spark, sf)
    return dy.daily_medians(s.where(dy.passes_quality(s)), ["participant_id", "modality", "date"], ["value"])


def _stats(spark, sf):
    long = dy.sessions_long(tb.feature_sessions(spark, sf))
    return dy.day_statistics(long, [*dy.DAY, "modality", "feature_name"])


@query(
    "E6_hinge_iqr",
    f"""WITH {LONG}, {STATS}
SELECT participant_id, CAST(date AS VARCHAR) AS date, modality, feature_name, n, iqr FROM stats""",
)
def hinge_iqr(spark, sf):
    return _stats(spark, sf).select(*dy.DAY, "modality", "feature_name", "n", "iqr")


@query(
    "E7_dispersion",
    f"""WITH {LONG}, {STATS}
SELECT participant_id, CAST(date AS VARCHAR) AS date, modality, feature_name, {r4("mean")} AS mean,
       {r4("coalesce(sd, 0e0)")} AS std, {r4("cv")} AS cv
FROM stats""",
)
def dispersion(spark, sf):
    s = _stats(spark, sf)
    return s.select(*dy.DAY, "modality", "feature_name", *[round4(F.col(c)).alias(c) for c in ("mean", "std", "cv")])


@query(
    "E8_disagreement",
    f"""WITH {LONG}, {STATS}
SELECT participant_id, CAST(date AS VARCHAR) AS date, modality, feature_name, n, disagree, {r4("cv")} AS cv, iqr,
       {r4("iqr_rel")} AS iqr_relative
FROM stats""",
)
def disagreement(spark, sf):
    d = dy.disagreement(_stats(spark, sf))
    return d.select(*dy.DAY, "modality", "feature_name", "n", "disagree", "cv", "iqr", "iqr_relative")


def _rollup_sql(m: str) -> str:
    feats = list(fv.MODALITY_FEATURES[m])
    watched = ", ".join(f"'{f}'" for f in feats if f in fv.DISAGREEMENT_NAMES) or "''"
    cols = ", ".join(
        f"max(median) FILTER (feature_name = '{f}') AS {f}, max(iqr) FILTER (feature_name = '{f}') AS {f}_iqr" for f in feats
    )
    return f"""WITH {LONG}, {STATS},
wide AS (SELECT participant_id, date, {cols}, count(*) FILTER (disagree AND feature_name IN ({watched})) AS disagreements
         FROM stats WHERE modality = '{m}' GROUP BY ALL)
SELECT w.* REPLACE (CAST(w.date AS VARCHAR) AS date), s.quality_score, s.passed_count AS session_count
FROM wide w JOIN status s ON s.participant_id = w.participant_id AND s.date = w.date AND s.modality = '{m}'"""


def _register_rollups() -> None:
    for m in fv.MODALITIES:
        query(f"E9_rollup_{m}", _rollup_sql(m))(lambda spark, sf, m=m: dy.rollup(tb.feature_sessions(spark, sf), m))


_register_rollups()

_day_cols = [(m, f) for m in fv.MODALITIES for f in fv.MODALITY_FEATURES[m]]
_watched = ", ".join(f"'{f}'" for f in fv.DISAGREEMENT_NAMES)
DAY_SQL = f"""{LONG}, {STATS},
flags AS (SELECT participant_id, date, {_flags} FROM status GROUP BY ALL),
tracked AS (SELECT participant_id, date, {_arrays}, {rn(f"(({_navail})/5e0)", 2)} AS completeness_ratio FROM flags),
{QUALITY},
feat AS (SELECT participant_id, date,
  {", ".join(f"max(median) FILTER (modality = '{m}' AND feature_name = '{f}') AS {m}__{f}" for m, f in _day_cols)},
  count(*) FILTER (disagree AND feature_name IN ({_watched})) AS disagreement_count
  FROM stats GROUP BY ALL)"""


@query(
    "E10_aggregate_day",
    f"""WITH {DAY_SQL}
SELECT * REPLACE (CAST(date AS VARCHAR) AS date, coalesce(disagreement_count, 0) AS disagreement_count)
FROM tracked JOIN quality USING (participant_id, date) LEFT JOIN feat USING (participant_id, date)""",
)
def aggregate_day(spark, sf):
    day = dy.aggregate_day(tb.feature_sessions(spark, sf))
    return day.drop("disagreements", *[f"{m}__{f}_iqr" for m, f in _day_cols])


# The rest of the day: the IQR of every feature and the records of disagreement.
_records = ", ".join(
    f"CASE WHEN d_{f} THEN '{m}:{fv.DISAGREEMENT_NAMES[f]}:Significant session disagreement in {fv.DISAGREEMENT_NAMES[f]}: CV=' || CAST(CAST(CAST(cv_{f} AS VARCHAR) AS DECIMAL(38,2)) AS VARCHAR) || ', relative IQR=' || CAST(CAST(CAST(rel_{f} AS VARCHAR) AS DECIMAL(38,2)) AS VARCHAR) END"
    for m, f in _day_cols
    if f in fv.DISAGREEMENT_NAMES
)
SPREAD_SQL = f"""{DAY_SQL},
spread AS (SELECT participant_id, date,
  {", ".join(f"max(iqr) FILTER (modality = '{m}' AND feature_name = '{f}') AS {m}__{f}_iqr" for m, f in _day_cols)},
  {", ".join(f"bool_or(disagree) FILTER (modality = '{m}' AND feature_name = '{f}') AS d_{f}, max(cv) FILTER (modality = '{m}' AND feature_name = '{f}') AS cv_{f}, max(iqr_rel) FILTER (modality = '{m}' AND feature_name = '{f}') AS rel_{f}" for m, f in _day_cols if f in fv.DISAGREEMENT_NAMES)}
  FROM stats GROUP BY ALL),
recorded AS (SELECT *, concat_ws('|', {_records}) AS disagreements FROM spread)"""


def _recorded():
    return F.transform("disagreements", lambda d: F.concat_ws(":", d["modality"], d["feature"], d["reason"])).alias("disagreements")


@query(
    "E10_aggregate_day_spread",
    f"""WITH {SPREAD_SQL}
SELECT t.participant_id, CAST(t.date AS VARCHAR) AS date, {", ".join(f"{m}__{f}_iqr" for m, f in _day_cols)}, coalesce(disagreements, '') AS disagreements
FROM tracked t LEFT JOIN recorded r ON r.participant_id = t.participant_id AND r.date = t.date""",
)
def aggregate_day_spread(spark, sf):
    day = dy.aggregate_day(tb.feature_sessions(spark, sf))
    return day.select(*dy.DAY, *[f"{m}__{f}_iqr" for m, f in _day_cols], _recorded())


@query(
    "E11_daily_vector",
    f"""WITH {DAY_SQL}
SELECT participant_id, CAST(date AS VARCHAR) AS date, '1.0' AS feature_version,
       {", ".join(f"CASE WHEN contains(available_modalities, '{m}') THEN {m}__{next(iter(fv.MODALITY_FEATURES[m]))} END AS {m}_first" for m in fv.MODALITIES)},
       {", ".join(f"contains(available_modalities, '{m}') AS has_{m}" for m in fv.MODALITIES)},
       overall_quality, available_modalities, missing_modalities
FROM tracked JOIN quality USING (participant_id, date) LEFT JOIN feat USING (participant_id, date)""",
)
def daily_vector(spark, sf):
    v = dy.daily_vector(tb.feature_sessions(spark, sf))
    return v.select(
        *dy.DAY,
        "feature_version",
        *[F.col(m)[next(iter(fv.MODALITY_FEATURES[m]))].alias(f"{m}_first") for m in fv.MODALITIES],
        *[F.col(m).isNotNull().alias(f"has_{m}") for m in fv.MODALITIES],
        "quality.overall_quality",
        "available_modalities",
        "missing_modalities",
    )


@query(
    "E11_daily_vector_features",
    f"""WITH {SPREAD_SQL}
SELECT t.participant_id, CAST(t.date AS VARCHAR) AS date,
       {", ".join(f"CASE WHEN contains(available_modalities, '{m}') THEN f.{m}__{n} END AS {m}__{n}, CASE WHEN contains(available_modalities, '{m}') THEN r.{m}__{n}_iqr END AS {m}__{n}_iqr" for m, n in _day_cols)},
       coalesce(f.disagreement_count, 0) AS disagreement_count, coalesce(disagreements, '') AS disagreements
FROM tracked t LEFT JOIN feat f ON f.participant_id = t.participant_id AND f.date = t.date LEFT JOIN recorded r ON r.participant_id = t.participant_id AND r.date = t.date""",
)
def daily_vector_features(spark, sf):
    v = dy.daily_vector(tb.feature_sessions(spark, sf))
    features = [c for m, n in _day_cols for c in (F.col(m)[n].alias(f"{m}__{n}"), F.col(f"iqr.{m}")[n].alias(f"{m}__{n}_iqr"))]
    return v.select(*dy.DAY, *features, "disagreement_count", _recorded())


@query(
    "E12_participant_rollup",
    f"""WITH {SESSIONS},
votes AS (SELECT participant_id, modality, count(*) AS n FROM sessions GROUP BY ALL),
modal AS (SELECT participant_id, modality FROM votes QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY n DESC, modality) = 1),
m AS (SELECT participant_id, {exact('value')}/count(*) AS value_mean, {mdn('value')} AS value_median,
             CAST(sum(k) AS DOUBLE)/count(*) AS k_mean
      FROM sessions GROUP BY ALL)
SELECT participant_id, {r4("value_mean")} AS value_mean, {r4("k_mean")} AS k_mean, {r4("value_median")} AS value_median, modality
FROM m JOIN modal USING (participant_id)""",
)
def participant_rollup(spark, sf):
    s = tb.sessions(spark, sf).select("participant_id", "modality", "value", F.col("k").cast("double").alias("k"))
    mean = dy.participant_rollup(s, "participant_id", ["value", "k"], "modality", "mean")
    median = dy.participant_rollup(s, "participant_id", ["value"], None, "median")
    return mean.join(median.withColumnRenamed("value", "value_median"), "participant_id").select(
        "participant_id",
        round4(F.col("value")).alias("value_mean"),
        round4(F.col("k")).alias("k_mean"),
        round4(F.col("value_median")).alias("value_median"),
        "modality",
    )


@query(
    "E13_binarize_at_median",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  CAST(l_extendedprice > (SELECT median(l_extendedprice) FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01') AS BIGINT) AS label
FROM lineitem""",
)
def binarize_at_median(spark, sf):
    li = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    train = li.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return dy.binarize_at_median(li, train, "l_extendedprice").drop("l_extendedprice", "l_shipdate")
