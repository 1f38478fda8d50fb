"""H: uploads, privacy and cohort. Events are uploads, orders consent records and predictions, customers participants."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import cohort as co
from driftwell.operators import daily as dy
from driftwell.operators import privacy as pv
from driftwell.operators import sync as sy
from driftwell.operators import trend as tr
from driftwell.plans import tables as tb
from driftwell.plans.daily_queries import STATUS
from driftwell.plans.quality_queries import _errs
from driftwell.plans.registry import query
from driftwell.plans.sqltext import HUB, SESSIONS, baseline_ctes, r4, rn, zscore_ctes

# Uploads: a session is one participant, day and modality, so a session sent several times that day repeats its key.
QUEUE = f"""{SESSIONS}, queue AS (SELECT event_id AS id, participant_id, participant_id || '-' || modality || '-' || CAST(date AS VARCHAR) AS session_id, ts AS timestamp,
  participant_id || '-' || modality || '-' || CAST(date AS VARCHAR) || '_' || k//50 AS idempotency_key, CASE WHEN k < 30 THEN 'failed' WHEN k < 60 THEN 'synced' WHEN k < 70 THEN 'syncing' ELSE 'pending' END AS status, k FROM sessions)"""


def _queue(spark, sf):
    s = tb.sessions(spark, sf)
    session = F.concat_ws("-", F.col("participant_id").cast("string"), "modality", F.col("date").cast("string"))
    return s.select(
        F.col("event_id").alias("id"),
        "participant_id",
        session.alias("session_id"),
        F.col("ts").alias("timestamp"),
        F.concat_ws("_", session, F.floor(F.col("k") / 50).cast("string")).alias("idempotency_key"),
        F.when(F.col("k") < 30, "failed").when(F.col("k") < 60, "synced").when(F.col("k") < 70, "syncing").otherwise("pending").alias("status"),
        "k",
    )


@query(
    "H1_dedup_uploads",
    f"""WITH {QUEUE}, a AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY timestamp, id) = 1 AS surv FROM queue),
b AS (SELECT *, max(CASE WHEN surv AND status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocked FROM a)
SELECT id, session_id, status, NOT surv OR coalesce(blocked, 0) = 1 AS is_duplicate FROM b""",
)
def dedup_uploads(spark, sf):
    return sy.dedup_uploads(_queue(spark, sf)).select("id", "session_id", "status", "is_duplicate")


# Keys that several sessions of a participant share, and some uploads without one: whether an upload is accepted depends on
# what became of the earlier ones, which the SQL follows upload by upload.
SHARED_KEYS = f"""{SESSIONS}, queue AS (SELECT event_id AS id, participant_id, participant_id || '-' || modality AS session_id, ts AS timestamp,
  CASE WHEN k % 9 <> 0 THEN participant_id || '_' || k//4 END AS given, CASE WHEN k < 60 THEN 'failed' ELSE 'pending' END AS status FROM sessions),
q AS (SELECT *, coalesce(given, session_id || '_' || participant_id || '_' || CAST(timestamp AS VARCHAR)) AS idempotency_key, row_number() OVER (PARTITION BY participant_id ORDER BY timestamp, id) AS t FROM queue),
r AS (SELECT DISTINCT participant_id, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS id, FALSE AS is_duplicate, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS held FROM q
  UNION ALL SELECT participant_id, t, id, d, CASE WHEN d THEN keys ELSE list_append(keys, idempotency_key) END, CASE WHEN d OR status = 'failed' THEN held ELSE list_append(held, session_id) END
  FROM (SELECT q.*, r.keys, r.held, list_contains(r.keys, q.idempotency_key) OR list_contains(r.held, q.session_id) AS d FROM r JOIN q ON q.participant_id = r.participant_id AND q.t = r.t + 1))"""


@query(
    "H1_dedup_uploads_shared_keys",
    f"WITH RECURSIVE {SHARED_KEYS} SELECT q.id, session_id, status, is_duplicate FROM q JOIN r USING (id)",
)
def dedup_shared_keys(spark, sf):
    person = F.col("participant_id").cast("string")
    queue = tb.sessions(spark, sf).select(
        F.col("event_id").alias("id"),
        "participant_id",
        F.concat_ws("-", person, "modality").alias("session_id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("k") % 9 != 0, F.concat_ws("_", person, F.floor(F.col("k") / 4).cast("string"))).alias("idempotency_key"),
        F.when(F.col("k") < 60, "failed").otherwise("pending").alias("status"),
    )
    return sy.dedup_uploads(queue).select("id", "session_id", "status", "is_duplicate")


VERSIONS = f"""{SESSIONS}, loc AS (SELECT event_id AS session_id, participant_id, value, k, date FROM sessions),
srv AS (SELECT event_id AS session_id, participant_id, CASE WHEN k < 20 THEN value + 1 ELSE value END AS value, CASE WHEN value > 150 THEN NULL ELSE k END AS k, date FROM sessions WHERE modality <> 'sleep'),
j AS (SELECT l.session_id, l.participant_id, l.value AS lv, s.value AS sv, l.k AS lk, s.k AS sk, s.session_id IS NOT NULL AS known FROM loc l LEFT JOIN srv s USING (session_id)),
d AS (SELECT *, CASE WHEN known THEN {_errs(("lv IS DISTINCT FROM sv", "value"), ("lk IS DISTINCT FROM sk", "k"))} ELSE '' END AS divergent_fields FROM j),
r AS (SELECT *, CASE WHEN NOT known THEN 'local_inserted' WHEN divergent_fields = '' THEN 'idempotent_match' ELSE 'server_wins' END AS resolution FROM d)"""


def _versions(spark, sf):
    s = tb.sessions(spark, sf)
    cols = [F.col("event_id").alias("session_id"), "participant_id", "value", "k", "date"]
    local = s.select(*cols, F.lit(False).alias("synced"))
    server = s.where("modality <> 'sleep'").withColumns(
        {"value": F.when(F.col("k") < 20, F.col("value") + 1).otherwise(F.col("value")), "k": F.when(F.col("value") <= 150, F.col("k"))}
    )
    return local, server.select(*cols, F.lit(True).alias("synced"))


@query("H2_divergent_fields", f"WITH {VERSIONS} SELECT session_id, divergent_fields FROM r WHERE known")
def divergent_fields(spark, sf):
    return sy.divergent_fields(*_versions(spark, sf))


@query(
    "H3_reconcile",
    f"WITH {VERSIONS} SELECT session_id, CASE WHEN known THEN sv ELSE lv END AS value, CAST(CASE WHEN known THEN sk ELSE lk END AS BIGINT) AS k, divergent_fields, resolution FROM r",
)
def reconcile(spark, sf):
    return sy.reconcile(*_versions(spark, sf)).select("session_id", "value", "k", "divergent_fields", "resolution")


@query(
    "H4_merge_sessions",
    f"""WITH {VERSIONS} SELECT session_id, participant_id, value, CAST(k AS BIGINT) AS k, TRUE AS synced FROM srv
UNION ALL SELECT session_id, participant_id, lv, CAST(lk AS BIGINT), FALSE FROM r WHERE NOT known""",
)
def merge_sessions(spark, sf):
    return sy.merge_sessions(*_versions(spark, sf)).drop("date")


@query("H5_sync_audit", f"WITH {VERSIONS} SELECT session_id, participant_id, 'synced' AS status, resolution, resolution = 'server_wins' AS conflict, divergent_fields FROM r")
def sync_audit(spark, sf):
    return sy.sync_audit(sy.reconcile(*_versions(spark, sf)))


@query(
    "H6_queue_stats",
    f"WITH {QUEUE} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "syncing", "synced", "failed")) + " FROM queue",
)
def queue_stats(spark, sf):
    return sy.queue_stats(_queue(spark, sf))


@query(
    "H7_classify_failures",
    f"""WITH {SESSIONS}, l AS (SELECT event_id, k//15 AS retry_count, CASE WHEN k < 20 THEN 'Network request failed' WHEN k < 40 THEN 'Bad Request' WHEN k < 60 THEN 'weird' WHEN k < 80 THEN 'Request Timeout' END AS e,
  CASE WHEN k < 10 THEN 404 WHEN k BETWEEN 50 AND 59 THEN 503 WHEN k >= 90 THEN 429 END AS c FROM sessions)
SELECT event_id, (NOT (coalesce(c = 404, FALSE) OR coalesce(lower(e) LIKE '%bad request%', FALSE))) AND (coalesce(c IN (503, 429), FALSE) OR coalesce(lower(e) LIKE '%network%' OR lower(e) LIKE '%timeout%', FALSE)) AS retryable,
  CAST(retry_count + 1 AS BIGINT) AS attempts, CASE WHEN retry_count + 1 >= 5 THEN 'failed' ELSE 'pending' END AS next_status FROM l""",
)
def classify_failures(spark, sf):
    k = F.col("k")
    log = tb.sessions(spark, sf).select(
        "event_id",
        F.floor(k / 15).alias("retry_count"),
        F.when(k < 20, "Network request failed").when(k < 40, "Bad Request").when(k < 60, "weird").when(k < 80, "Request Timeout").alias("last_error"),
        F.when(k < 10, 404).when(k.between(50, 59), 503).when(k >= 90, 429).alias("status_code"),
    )
    return sy.classify_failures(log).select("event_id", "retryable", "attempts", "next_status")


# Consent records: one per order; the priority stands for the consent type.
PRIORITY_TYPE = {
    "1-URGENT": "data_collection",
    "2-HIGH": "keyboard_access",
    "3-MEDIUM": "microphone_access",
    "4-NOT SPECIFIED": "motion_access",
    "5-LOW": "camera_access",
}
TYPES = list(PRIORITY_TYPE.values())
_case = " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in PRIORITY_TYPE.items())
CONSENT = f"""log AS (SELECT o_orderkey AS record_id, o_custkey AS participant_id, CASE o_orderpriority {_case} END AS consent_type, o_orderdate AS timestamp, o_orderstatus <> 'F' AS granted,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 9 DAYS END AS revoked_at FROM orders),
state AS (SELECT participant_id, consent_type, granted, revoked_at, granted AND revoked_at IS NULL AS active FROM log QUALIFY row_number() OVER (PARTITION BY participant_id, consent_type ORDER BY timestamp DESC, record_id DESC) = 1)"""


def _consents(spark, sf):
    o = tb.table(spark, sf, "orders")
    kind = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(t)) for p, t in PRIORITY_TYPE.items()])
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("participant_id"),
        kind.alias("consent_type"),
        F.lit("1.0").alias("consent_version"),
        F.col("o_orderdate").alias("timestamp"),
        (F.col("o_orderstatus") != "F").alias("granted"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("INTERVAL 9 DAYS")).alias("revoked_at"),
    )


@query("H8_consent_state", f"WITH {CONSENT} SELECT participant_id, consent_type, granted, revoked_at IS NOT NULL AS revoked, active FROM state")
def consent_state(spark, sf):
    return pv.consent_state(_consents(spark, sf)).select("participant_id", "consent_type", "granted", F.col("revoked_at").isNotNull().alias("revoked"), "active")


@query(
    "H9_consented_sessions",
    f"""WITH {SESSIONS}, {CONSENT}, n AS (SELECT event_id, participant_id, modality, CASE modality WHEN 'typing' THEN 'keyboard_access' WHEN 'voice' THEN 'microphone_access' WHEN 'motor' THEN 'motion_access' WHEN 'visual' THEN 'camera_access' ELSE 'data_collection' END AS need FROM sessions)
SELECT event_id, participant_id, modality FROM n WHERE EXISTS (SELECT 1 FROM state s WHERE s.participant_id = n.participant_id AND active AND consent_type = 'data_collection')
  AND EXISTS (SELECT 1 FROM state s WHERE s.participant_id = n.participant_id AND active AND consent_type = need)""",
)
def consented_sessions(spark, sf):
    s = tb.sessions(spark, sf).select("event_id", "participant_id", "modality")
    return pv.consented_sessions(s, _consents(spark, sf))


REQUESTS = """req AS (SELECT c_custkey AS participant_id, CASE WHEN c_acctbal < 1000 THEN 'all' ELSE 'motion_access' END AS consent_type, TIMESTAMP '2003-01-01' + to_days(c_nationkey) AS requested_at FROM customer WHERE c_acctbal < 1000 OR c_mktsegment = 'BUILDING')"""


def _requests(spark, sf):
    c = tb.table(spark, sf, "customer").where((F.col("c_acctbal") < 1000) | (F.col("c_mktsegment") == "BUILDING"))
    return c.select(
        F.col("c_custkey").alias("participant_id"),
        F.when(F.col("c_acctbal") < 1000, "all").otherwise("motion_access").alias("consent_type"),
        F.date_add(F.lit("2003-01-01").cast("date"), F.col("c_nationkey")).cast("timestamp_ntz").alias("requested_at"),
    )


@query(
    "H10_apply_revocations",
    f"""WITH {CONSENT}, {REQUESTS}, j AS (SELECT l.*, (SELECT min(requested_at) FROM req r WHERE r.participant_id = l.participant_id AND r.consent_type IN ('all', l.consent_type)) AS w FROM log l)
SELECT record_id, CASE WHEN revoked_at IS NULL AND w IS NOT NULL THEN FALSE ELSE granted END AS granted, CAST(CAST(coalesce(revoked_at, w) AS DATE) AS VARCHAR) AS revoked_on, revoked_at IS NULL AND w IS NOT NULL AS affected FROM j""",
)
def apply_revocations(spark, sf):
    out = pv.apply_revocations(_consents(spark, sf), _requests(spark, sf))
    return out.select("record_id", "granted", F.to_date("revoked_at").alias("revoked_on"), "affected")


@query("H11_consent_snapshot", f"WITH {CONSENT} SELECT participant_id, " + ", ".join(f"coalesce(bool_or(active) FILTER (consent_type = '{t}'), FALSE) AS {t}" for t in TYPES) + " FROM state GROUP BY ALL")
def consent_snapshot(spark, sf):
    return pv.consent_snapshot(_consents(spark, sf), TYPES)


def _owned(spark, sf):
    s = tb.sessions(spark, sf).select("participant_id", "event_id", "modality", "value")
    tables = {f"{m}_sessions": s.where(F.col("modality") == m) for m in tb.EVENT_MODALITY.values()}
    hub, base = tb.calibrated(spark, sf)
    tables["daily_features"] = hub.select("participant_id", "date", "value")
    tables["personal_baselines"] = base.select("participant_id", "baseline_median")
    tables["daily_deviations"] = tr.deviation_record(tr.deviation(hub, base)).select("participant_id", "date", "deviation_score")
    tables["consent_records"] = _consents(spark, sf)
    tables["mpf_predictions"] = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("participant_id"), "o_orderkey", "o_totalprice")
    tables["participants"] = _participants(spark, sf)
    return tables


def _participants(spark, sf):
    return tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("participant_id"), "c_name")


OWNED = f"""{zscore_ctes()}, {CONSENT}, owned AS (SELECT participant_id, modality || '_sessions' AS t FROM sessions UNION ALL SELECT participant_id, 'consent_records' FROM log
  UNION ALL SELECT participant_id, 'daily_features' FROM hub UNION ALL SELECT participant_id, 'personal_baselines' FROM baseline UNION ALL SELECT participant_id, 'daily_deviations' FROM dev
  UNION ALL SELECT o_custkey, 'mpf_predictions' FROM orders UNION ALL SELECT c_custkey, 'participants' FROM customer)"""


@query("H12_erase_counts", f"WITH {OWNED}, {REQUESTS} SELECT participant_id, t AS table_name, count(*) AS purged FROM owned WHERE t NOT IN ('consent_records', 'participants') AND participant_id IN (SELECT participant_id FROM req WHERE consent_type = 'all') GROUP BY ALL")
def erase_counts(spark, sf):
    return pv.erase(_owned(spark, sf), _requests(spark, sf).where("consent_type = 'all'"))[1]


@query("H12_erase_remaining", f"WITH {OWNED}, {REQUESTS} SELECT t AS table_name, count(*) AS remaining FROM owned WHERE t IN ('consent_records', 'participants') OR participant_id NOT IN (SELECT participant_id FROM req WHERE consent_type = 'all') GROUP BY ALL")
def erase_remaining(spark, sf):
    from functools import reduce

    kept = pv.erase(_owned(spark, sf), _requests(spark, sf).where("consent_type = 'all'"))[0]
    return reduce(lambda a, b: a.unionByName(b), [df.groupBy(F.lit(n).alias("table_name")).agg(F.count(F.lit(1)).alias("remaining")) for n, df in kept.items()])


@query("H12_erasure_audit", f"WITH {REQUESTS} SELECT participant_id, 'deletion' AS consent_type, '1.0.0' AS consent_version, TRUE AS granted, CAST(CAST(min(requested_at) AS DATE) AS VARCHAR) AS recorded_on FROM req WHERE consent_type = 'all' GROUP BY participant_id")
def erasure_audit(spark, sf):
    out = pv.erasure_audit(_requests(spark, sf).where("consent_type = 'all'"))
    return out.select("participant_id", "consent_type", "consent_version", "granted", F.to_date("timestamp").alias("recorded_on"))


@query("H12_soft_delete", f"WITH {REQUESTS} SELECT c_custkey AS participant_id, CAST(CAST(requested_at AS DATE) AS VARCHAR) AS deleted_on, requested_at IS NOT NULL AS is_deleted FROM customer LEFT JOIN (SELECT * FROM req WHERE consent_type = 'all') r ON r.participant_id = c_custkey")
def soft_delete(spark, sf):
    out = pv.soft_delete(_participants(spark, sf), _requests(spark, sf).where("consent_type = 'all'"))
    return out.select("participant_id", F.to_date("deleted_at").alias("deleted_on"), "is_deleted")


SECTIONS = [f"{m}_sessions" for m in tb.EVENT_MODALITY.values()] + ["daily_features", "personal_baselines", "daily_deviations", "consent_records", "mpf_predictions", "participants"]


@query("H13_export_summary", f"WITH {OWNED} SELECT participant_id, " + ", ".join(f"count(*) FILTER (t = '{s}') AS total_{s}" for s in SECTIONS) + " FROM owned GROUP BY ALL")
def export_summary(spark, sf):
    return pv.export_summary(pv.export_package(_owned(spark, sf)), SECTIONS)


@query("H13_export_package", """SELECT c_custkey AS participant_id, 'participants' AS section, '{"participant_id":' || c_custkey || ',"c_name":"' || c_name || '"}' AS record FROM customer""")
def export_package(spark, sf):
    return pv.export_package({"participants": _participants(spark, sf)})


def _number(e: str) -> str:
    """A double of four decimals below ten millions as JSON text; below a thousandth with an exponent."""
    return f"CASE WHEN {e} <> 0 AND abs({e}) < 0.001 THEN CAST(CAST(round({e}*1e4) AS BIGINT) AS VARCHAR) || '.0E-4' ELSE CAST({e} AS VARCHAR) END"


def _line(section: str, source: str, owner: str = "participant_id", **fields: str) -> str:
    """One section of the package: JSON objects of the fields that are not null."""
    parts = ", ".join(f"""'"{k}":' || {e}""" for k, e in ({"participant_id": owner} | fields if "participant_id" not in fields else fields).items())
    return f"""SELECT {owner} AS participant_id, {section} AS section, '{{' || concat_ws(',', {parts}) || '}}' AS record FROM {source}"""


def _quoted(e: str) -> str:
    return f"""('"' || {e} || '"')"""


_moment = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000')"
PACKAGE = " UNION ALL ".join(
    [
        _line("modality || '_sessions'", "sessions", event_id="event_id", modality=_quoted("modality"), value=_number("value")),
        _line("'daily_features'", "hub", date=_quoted("CAST(date AS VARCHAR)"), value=_number("value")),
        _line("'personal_baselines'", "baseline", baseline_median=_number("baseline_median")),
        _line("'daily_deviations'", "dev", date=_quoted("CAST(date AS VARCHAR)"), deviation_score=_number("z_score")),
        _line("'consent_records'", "log", record_id="record_id", participant_id="participant_id", consent_type=_quoted("consent_type"), consent_version="'\"1.0\"'", timestamp=_quoted(_moment.format("timestamp")), granted="granted", revoked_at=_quoted(_moment.format("revoked_at"))),
        _line("'mpf_predictions'", "orders", owner="o_custkey", o_orderkey="o_orderkey", o_totalprice=_number("o_totalprice")),
        _line("'participants'", "customer", owner="c_custkey", c_name=_quoted("c_name")),
    ]
)


@query("H13_export_package_sections", f"WITH {zscore_ctes()}, {CONSENT} {PACKAGE}")
def export_package_sections(spark, sf):
    """All eleven sections of every participant."""
    return pv.export_package(_owned(spark, sf))


@query("H14_isolate", f"WITH {SESSIONS} SELECT event_id, participant_id, value FROM sessions WHERE participant_id = 7")
def isolate(spark, sf):
    return pv.isolate(tb.sessions(spark, sf), 7).select("event_id", "participant_id", "value")


@query(
    "H15_dashboard_summary",
    f"""WITH {zscore_ctes()}, last AS (SELECT o_custkey AS participant_id, o_orderkey AS prediction_id, {r4("(o_totalprice/5e5)")} AS risk_score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
d AS (SELECT participant_id, count(*) AS n FROM hub GROUP BY ALL), e AS (SELECT participant_id, count(*) AS n FROM dev WHERE abs(z_score) >= 1.5 GROUP BY ALL)
SELECT c_custkey AS participant_id, coalesce(d.n, 0) AS total_collection_days, coalesce(e.n, 0) AS total_deviation_events, prediction_id, risk_score
FROM customer LEFT JOIN d ON d.participant_id = c_custkey LEFT JOIN e ON e.participant_id = c_custkey LEFT JOIN last l ON l.participant_id = c_custkey""",
)
def dashboard_summary(spark, sf):
    hub, base = tb.calibrated(spark, sf)
    dev = tr.deviation_record(tr.deviation(hub, base))
    o = tb.table(spark, sf, "orders")
    preds = o.select(F.col("o_custkey").alias("participant_id"), F.col("o_orderkey").alias("prediction_id"), co.round4(F.col("o_totalprice") / 5e5).alias("risk_score"), F.col("o_orderdate").alias("created_at"))
    out = co.dashboard_summary(_participants(spark, sf), hub, dev, preds)
    return out.select("participant_id", "total_collection_days", "total_deviation_events", "latest.prediction_id", "latest.risk_score")


COHORT = """c AS (SELECT c_custkey AS participant_id, c_name, c_mktsegment, c_acctbal AS risk_index, CASE WHEN c_acctbal >= 6500 THEN 'elevated' WHEN c_acctbal >= 4000 THEN 'intermediate' ELSE 'low' END AS risk_class, c_nationkey < 5 AS family_history FROM customer)"""


def _cohort(spark, sf):
    c = tb.table(spark, sf, "customer")
    risk = F.when(F.col("c_acctbal") >= 6500, "elevated").when(F.col("c_acctbal") >= 4000, "intermediate").otherwise("low")
    return c.select(F.col("c_custkey").alias("participant_id"), "c_name", "c_mktsegment", F.col("c_acctbal").alias("risk_index"), risk.alias("risk_class"), (F.col("c_nationkey") < 5).alias("family_history"))


@query(
    "H16_cohort_list",
    f"WITH {COHORT} SELECT participant_id, risk_index, risk_class FROM c WHERE risk_class = 'elevated' AND (lower(c_name) LIKE '%build%' OR lower(c_mktsegment) LIKE '%build%' OR CAST(participant_id AS VARCHAR) LIKE '%build%')",
)
def cohort_list(spark, sf):
    out = co.cohort_list(_cohort(spark, sf), "elevated", None, " Build ", ["c_name", "c_mktsegment", "participant_id"], "risk-desc")
    return out.select("participant_id", "risk_index", "risk_class")


@query("H17_facet_counts", f"WITH {COHORT} SELECT count(*) AS all_rows, count(*) FILTER (risk_class='elevated') AS elevated, count(*) FILTER (risk_class='intermediate') AS intermediate, count(*) FILTER (risk_class='low') AS low, count(*) FILTER (family_history) AS family_history FROM c")
def facet_counts(spark, sf):
    return co.facet_counts(_cohort(spark, sf), ["elevated", "intermediate", "low"], "family_history")


@query("H18_active_models", "SELECT p_brand AS model_name, p_partkey AS version FROM part WHERE p_size < 40 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) = 1")
def active_models(spark, sf):
    p = tb.table(spark, sf, "part")
    return co.active_models(p.select(F.col("p_brand").alias("model_name"), F.col("p_partkey").alias("version"), (F.col("p_size") < 40).alias("active"), F.col("p_retailprice").alias("created_at")))


@query("H19_audit_counts", "SELECT event_type AS action_type, count(*) AS n FROM events GROUP BY ALL")
def audit_counts(spark, sf):
    return co.audit_counts(tb.table(spark, sf, "events").withColumnRenamed("event_type", "action_type"))


@query(
    "H20_trend_series",
    f"""WITH {baseline_ctes()}, spine AS (SELECT participant_id, modality, feature_name, baseline_mean, baseline_std, CAST(unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date FROM baseline)
SELECT participant_id, modality, feature_name, CAST(date AS VARCHAR) AS date, value, {r4("(baseline_mean-baseline_std)")} AS band_low, {r4("(baseline_mean+baseline_std)")} AS band_high,
  CASE WHEN value IS NOT NULL THEN abs(CASE WHEN baseline_std > 0 THEN (value-baseline_mean)/baseline_std ELSE 0e0 END) >= 1.5 END AS deviated
FROM spine LEFT JOIN hub USING (participant_id, modality, feature_name, date)""",
)
def trend_series(spark, sf):
    hub, base = tb.calibrated(spark, sf)
    return co.trend_series(hub, base, "2024-01-30", 14)


@query("H21_compare", f"WITH {COHORT} SELECT a.participant_id AS a, b.participant_id AS b, {rn('(a.risk_index-b.risk_index)', 2)} AS risk_delta, abs({rn('(a.risk_index-b.risk_index)', 2)}) AS magnitude FROM c a JOIN c b ON b.participant_id = a.participant_id + 1")
def compare(spark, sf):
    c = _cohort(spark, sf)
    return co.compare(c, c.select(F.col("participant_id").alias("a"), (F.col("participant_id") + 1).alias("b")))


@query("H22_quality_panel", f"WITH {STATUS} SELECT participant_id, CAST(date AS VARCHAR) AS date, CAST(floor(CAST(sum(CAST(floor(quality_score*1e4+0.5) AS BIGINT)) AS DOUBLE)/count(*)/1e2+0.5) AS BIGINT) AS avg_quality_pct FROM status GROUP BY participant_id, date")
def quality_panel(spark, sf):
    return co.quality_panel(dy.modality_status(tb.sessions(spark, sf)), ["participant_id", "date"])


@query("H23_expire", f"WITH {SESSIONS} SELECT event_id, CAST(date AS VARCHAR) AS date FROM sessions WHERE date >= DATE '2024-02-10' - CAST(CASE WHEN modality = 'voice' THEN 15 ELSE 30 END AS INTEGER)")
def expire(spark, sf):
    keep = F.when(F.col("modality") == "voice", 15).otherwise(30)
    return pv.expire(tb.sessions(spark, sf), keep, "2024-02-10").select("event_id", "date")
