"""B: data quality and leakage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv
from driftwell.operators import daily as dy
from driftwell.operators import quality as dq
from driftwell.plans import tables as tb
from driftwell.plans.registry import query
from driftwell.plans.sqltext import SESSIONS, mdn, r4

# Lineitem with some values blanked, so that the missingness checks have something to find.
BLANKED = """li AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.05::DOUBLE) AS l_discount,
  CASE WHEN l_tax >= 0.03::DOUBLE THEN NULL ELSE l_tax END AS l_tax, l_quantity, l_returnflag FROM lineitem)"""
COLS = ["l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_returnflag"]
UUID = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _uuid(c: Column) -> Column:
    return F.regexp_replace(F.md5(c.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _blanked(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_tax") < 0.03, F.col("l_tax")).alias("l_tax"),
        "l_quantity",
        "l_returnflag",
    )


def _errs(*pairs: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in pairs) + ")"


@query(
    "B1_required_columns",
    f"""WITH {BLANKED}
SELECT 'l_orderkey' AS column_name, TRUE AS present, count(l_orderkey) AS non_null FROM li
UNION ALL SELECT 'l_tax', TRUE, count(l_tax) FROM li UNION ALL SELECT 'l_weight', FALSE, 0""",
)
def required_columns(spark, sf):
    return dq.check_columns(_blanked(spark, sf), ["l_orderkey", "l_tax", "l_weight"])


@query(
    "B2_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, occurrences FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL) WHERE occurrences > 1",
)
def duplicate_keys(spark, sf):
    return dq.duplicate_keys(tb.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


ALLOWED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(
    "B3_invalid_labels",
    "SELECT o_orderpriority AS label, count(*) AS occurrences FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM') GROUP BY ALL",
)
def invalid_labels(spark, sf):
    return dq.invalid_labels(tb.table(spark, sf, "orders"), "o_orderpriority", ALLOWED)


def _missing_sql(extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, {r4(f'((count(*)-count({c}))/CAST(count(*) AS DOUBLE))')} AS null_ratio, "
        f"(count(*)-count({c}))/CAST(count(*) AS DOUBLE) > 0.5 AS flagged{extra} FROM li"
        for c in COLS
    )


@query("B4_missingness", f"WITH {BLANKED} {_missing_sql()}")
def missingness(spark, sf):
    return dq.missingness(_blanked(spark, sf))


# Splits by ship date: an order with lines on both sides of a border is shared by two splits.
SPLITS = ["train", "val", "test"]
SPLIT_SQL = """s AS (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS split FROM lineitem)"""


@query(
    "B5_split_overlap",
    f"""WITH {SPLIT_SQL}, m AS (SELECT l_orderkey, bool_or(split='train') AS train, bool_or(split='val') AS val, bool_or(split='test') AS test FROM s GROUP BY ALL)
SELECT 'train' AS split_a, 'val' AS split_b, count(*) FILTER (train AND val) AS shared FROM m
UNION ALL SELECT 'train', 'test', count(*) FILTER (train AND test) FROM m UNION ALL SELECT 'val', 'test', count(*) FILTER (val AND test) FROM m""",
)
def split_overlap(spark, sf):
    d = F.col("l_shipdate").cast("date")
    split = F.when(d < F.lit("1998-01-01").cast("date"), "train").when(d < F.lit("2000-01-01").cast("date"), "val").otherwise("test")
    li = tb.table(spark, sf, "lineitem").select("l_orderkey", split.alias("split"))
    return dq.split_overlap(li, "l_orderkey", "split", SPLITS)


@query(
    "B6_missing_modalities",
    f"""WITH {SESSIONS}, d AS (SELECT participant_id, date, list(DISTINCT modality) AS have FROM sessions GROUP BY ALL)
SELECT participant_id, CAST(date AS VARCHAR) AS date, concat_ws('|', {", ".join(f"CASE WHEN NOT list_contains(have, '{m}') THEN '{m}' END" for m in fv.MODALITIES)}) AS missing_modalities FROM d""",
)
def missing_modalities(spark, sf):
    return dq.missing_modalities(tb.sessions(spark, sf), fv.MODALITIES, ["participant_id", "date"])


MODS = ["typing", "voice", "motor"]


@query(
    "B7_cohort_integrity",
    f"""WITH {SESSIONS},
w AS (SELECT participant_id, date, {", ".join(f"max(value) FILTER (modality = '{m}') AS {m}_value" for m in MODS)} FROM sessions GROUP BY ALL)
SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT participant_id FROM w GROUP BY 1 HAVING count(*) > 1)) AS bad_ids,
  count(*) FILTER ({" AND ".join(f"{m}_value IS NULL" for m in MODS)}) AS all_missing,
  count(*) FILTER ({" AND ".join(f"{m}_value IS NOT NULL" for m in MODS)}) AS fully_observed,
  {", ".join(f"count({m}_value) AS {m}_present, {r4(f'(count({m}_value)/CAST(count(*) AS DOUBLE))')} AS {m}_ratio" for m in MODS)}
FROM w""",
)
def cohort_integrity(spark, sf):
    wide = tb.sessions(spark, sf).groupBy("participant_id", "date").agg(
        *[F.max(F.when(F.col("modality") == m, F.col("value"))).alias(f"{m}_value") for m in MODS]
    )
    return dq.cohort_integrity(wide, "participant_id", {m: [f"{m}_value"] for m in MODS})


@query(
    "B8_integrity_report",
    f"""WITH {BLANKED}, miss AS ({_missing_sql()})
SELECT 'missing_column' AS "check", 'l_weight' AS subject, CAST(1 AS BIGINT) AS count
UNION ALL SELECT 'duplicate_key', 'l_orderkey', count(*) FROM (SELECT l_orderkey FROM li GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'invalid_label', l_returnflag, count(*) FROM li WHERE l_returnflag NOT IN ('A','R') GROUP BY l_returnflag
UNION ALL SELECT 'missingness', column_name, nulls FROM miss WHERE flagged""",
)
def integrity_report(spark, sf):
    return dq.integrity_report(_blanked(spark, sf), ["l_orderkey", "l_tax", "l_weight"], ["l_orderkey"], "l_returnflag", ["A", "R"])


@query("B9_profile", f"WITH {BLANKED} SELECT column_name, nulls, null_ratio, n_rows, n_columns FROM ({_missing_sql(', count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns')})")
def profile(spark, sf):
    return dq.profile(_blanked(spark, sf))


RANGES = {"l_discount": (0.02, 0.08), "l_tax": (0.01, 0.02), "l_quantity": (5, 45)}


@query(
    "B10_range_violations",
    f"WITH {BLANKED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} < {lo}::DOUBLE OR {c} > {hi}::DOUBLE) AS out_of_range, "
        f"{r4(f'((count(*)-count({c}))/CAST(count(*) AS DOUBLE))')} AS missing_fraction, (count(*)-count({c}))/CAST(count(*) AS DOUBLE) > 0.5 AS too_sparse FROM li"
        for c, (lo, hi) in RANGES.items()
    ),
)
def range_violations(spark, sf):
    return dq.range_violations(_blanked(spark, sf), RANGES)


TRIAL = f"""{SESSIONS},
smp AS (SELECT participant_id AS trial, CAST(floor(epoch(ts)/3600) AS BIGINT) AS time, CASE WHEN k < 55 THEN NULL ELSE CAST(k AS DOUBLE) END AS l1,
  CASE WHEN k < 40 THEN NULL ELSE value END AS r1, value-29.5::DOUBLE AS total_left, CASE WHEN k < 30 THEN 0e0 ELSE k/1e2 END AS total_right FROM sessions),
q AS (SELECT trial, count(*) AS n_samples, CAST(max(time)-min(time) AS BIGINT) AS duration, (count(*)-count(l1))/CAST(count(*) AS DOUBLE) AS nl, (count(*)-count(r1))/CAST(count(*) AS DOUBLE) AS nr,
  {r4(mdn("total_left"))} AS ml, {r4(mdn("total_right"))} AS mr FROM smp GROUP BY ALL)"""


@query(
    "B11_trial_qc",
    f"""WITH {TRIAL}
SELECT trial, n_samples, duration, {_errs(("n_samples > 1 AND duration < 690", "duration"), ("ml < 0.5", "low_force:total_left"), ("mr < 0.5", "low_force:total_right"), ("nl > 0.5", "missing:l1"), ("nr > 0.5", "missing:r1"))} AS issues,
  {_errs(("n_samples > 1 AND abs(n_samples - floor(duration*0.1::DOUBLE))/greatest(floor(duration*0.1::DOUBLE), 1) > 0.05", "sample_count"))} AS warnings
FROM q""",
)
def trial_qc(spark, sf):
    return _trial_qc(spark, sf).select("trial", "n_samples", "duration", "issues", "warnings")


def _trial_qc(spark, sf):
    s = tb.sessions(spark, sf)
    samples = s.select(
        F.col("participant_id").alias("trial"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("time"),
        F.when(F.col("k") >= 55, F.col("k").cast("double")).alias("l1"),
        F.when(F.col("k") >= 40, F.col("value")).alias("r1"),
        F.col("value").alias("total_left"),
        F.when(F.col("k") < 30, 0.0).otherwise(F.col("k") / 100.0).alias("total_right"),
    )
    # The force floor of the left total is shifted so that both verdicts occur on the given values.
    samples = samples.withColumn("total_left", F.col("total_left") - 29.5)
    return dq.trial_qc(samples, "trial", ["l1", "r1"], ["total_left", "total_right"], rate_hz=0.1, min_seconds=690, min_force=0.5)


@query(
    "B12_motor_quality",
    f"""WITH {TRIAL}, v AS (SELECT (n_samples > 1 AND duration < 690) OR ml < 0.5 OR mr < 0.5 OR nl > 0.5 OR nr > 0.5 AS bad FROM q)
SELECT NOT bad AS passed, count(*) AS trials FROM v GROUP BY 1""",
)
def motor_quality(spark, sf):
    return _trial_qc(spark, sf).groupBy("passed").agg(F.count(F.lit(1)).alias("trials"))


@query(
    "B13_validate_sessions",
    f"""WITH {SESSIONS}, v AS (SELECT event_id, CASE WHEN k < 5 THEN 'raw-' || event_id ELSE {UUID.format("CAST(event_id AS VARCHAR)")} END AS session_id,
  value, k, CASE WHEN k > 90 THEN 'humming' ELSE 'read_sentence' END AS task_type FROM sessions)
SELECT event_id, {_errs(("k < 5", "invalid_session_id"), ("k > 90", "invalid_task_type"), ("k > 60", "out_of_range_signal_quality"), ("value < 10", "out_of_range_shimmer"), ("k < 10", "out_of_range_hnr"))} AS errors FROM v""",
)
def validate_sessions(spark, sf):
    s = tb.sessions(spark, sf)
    v = s.select(
        "event_id",
        _uuid(F.col("participant_id")).alias("participant_id"),
        F.when(F.col("k") < 5, F.concat(F.lit("raw-"), F.col("event_id").cast("string"))).otherwise(_uuid(F.col("event_id"))).alias("session_id"),
        F.when(F.col("k") > 90, "humming").otherwise("read_sentence").alias("task_type"),
        F.col("value").alias("duration"),
        (F.col("k") / 60.0).alias("signal_quality"),
        F.col("value").alias("jitter"),
        (F.col("value") - 10).alias("shimmer"),
        F.when(F.col("k") >= 10, F.col("value")).alias("hnr"),
        F.col("value").alias("pitch_mean"),
        F.col("value").alias("pitch_std"),
        "quality_score",
    )
    return dq.validate_sessions(v, "voice").select("event_id", "errors")


def _tampered(spark, sf):
    """Daily vectors with a modality wrongly listed as missing on days of low overall quality."""
    v = dy.daily_vector(tb.feature_sessions(spark, sf))
    low = F.col("quality.overall_quality") < 0.3
    return v.withColumns(
        {
            "participant_id": F.when(low, F.lit("anonymous")).otherwise(_uuid(F.col("participant_id"))),
            "pid": F.col("participant_id"),
            "missing_modalities": F.when(low, F.array_union("missing_modalities", F.array(F.lit("typing")))).otherwise(F.col("missing_modalities")),
        }
    )


from driftwell.plans.daily_queries import DAY_SQL  # noqa: E402

_bad = "overall_quality < 0.3 AND contains(available_modalities, 'typing')"
_DAYS = f"{DAY_SQL}, d AS (SELECT * FROM tracked JOIN quality USING (participant_id, date))"


@query(
    "B14_validate_daily",
    f"""WITH {_DAYS}
SELECT participant_id AS pid, CAST(date AS VARCHAR) AS date, {_errs(("overall_quality < 0.3", "participant_id"), (_bad, "available_and_missing"), (_bad, "imputed:typing"))} AS errors FROM d""",
)
def validate_daily(spark, sf):
    return dq.validate_daily(_tampered(spark, sf)).select("pid", "date", "errors")


@query(
    "B15_no_imputation_audit",
    f"""WITH {_DAYS}
SELECT participant_id AS pid, CAST(date AS VARCHAR) AS date, {_errs((_bad, "available_and_missing"), (_bad, "imputed:typing"))} AS errors FROM d""",
)
def audit_no_imputation(spark, sf):
    return dq.audit_no_imputation(_tampered(spark, sf)).select("pid", "date", "errors")


DOC_SPLIT = """sp AS (SELECT source, CASE WHEN lang = 'en' THEN 'train' WHEN n_chars < 1000 THEN 'val' ELSE 'test' END AS split,
  sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents)"""


def _documents(spark, sf):
    d = tb.table(spark, sf, "documents")
    return d.withColumn("split", F.when(F.col("lang") == "en", "train").when(F.col("n_chars") < 1000, "val").otherwise("test"))


@query(
    "B16_leakage_report",
    f"""WITH {DOC_SPLIT}, p AS (SELECT h, split, count(*) AS n FROM sp GROUP BY ALL), ids AS (SELECT DISTINCT source, split FROM sp),
pairs(split_a, split_b) AS (VALUES ('train','val'), ('train','test'), ('val','test'))
SELECT split_a, split_b, (SELECT count(*) FROM p a JOIN p b USING (h) WHERE a.split = split_a AND b.split = split_b) AS shared_texts,
  CAST((SELECT coalesce(sum(a.n), 0) FROM p a JOIN p b USING (h) WHERE a.split = split_a AND b.split = split_b) AS BIGINT) AS rows_a,
  CAST((SELECT coalesce(sum(b.n), 0) FROM p a JOIN p b USING (h) WHERE a.split = split_a AND b.split = split_b) AS BIGINT) AS rows_b,
  (SELECT count(*) FROM ids a JOIN ids b USING (source) WHERE a.split = split_a AND b.split = split_b) AS shared_ids
FROM pairs""",
)
def leakage_report(spark, sf):
    return dq.leakage_report(_documents(spark, sf), "split", "source", "text", SPLITS)


@query(
    "B16_class_balance",
    """SELECT CASE WHEN lang = 'en' THEN 'train' WHEN n_chars < 1000 THEN 'val' ELSE 'test' END AS split,
  count(*) FILTER (toxic = 0) AS control, count(*) FILTER (toxic = 1) AS "case", count(*) AS samples
FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def class_balance(spark, sf):
    d = _documents(spark, sf).select("doc_id", "split").join(tb.table(spark, sf, "labels"), "doc_id")
    return dq.class_balance(d, "split", "toxic")


@query(
    "B17_demographics",
    f"""WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'n/a' ELSE CAST(CAST(floor(c_acctbal/60) AS BIGINT) AS VARCHAR) END AS age,
  CASE WHEN c_nationkey < 10 THEN ' M' WHEN c_nationkey < 15 THEN 'Male' ELSE 'other' END AS sex FROM customer), v AS (SELECT *, try_cast(age AS DOUBLE) AS age_value FROM c)
SELECT c_custkey, age_value, CASE WHEN lower(trim(sex)) IN ('m','male','1') THEN 'male' ELSE 'female' END AS sex_value,
  {_errs(("age IS NULL", "age_required"), ("age IS NOT NULL AND age_value IS NULL", "age_not_numeric"), ("age_value < 18 OR age_value > 120", "age_out_of_range"))} AS errors FROM v""",
)
def demographics(spark, sf):
    c = tb.table(spark, sf, "customer")
    age = F.when(F.col("c_mktsegment") == "FURNITURE", None).when(F.col("c_mktsegment") == "MACHINERY", "n/a").otherwise(F.floor(F.col("c_acctbal") / 60).cast("string"))
    sex = F.when(F.col("c_nationkey") < 10, " M").when(F.col("c_nationkey") < 15, "Male").otherwise("other")
    out = dq.validate_demographics(c.select("c_custkey", age.alias("age"), sex.alias("sex")))
    return out.select("c_custkey", "age_value", "sex_value", "errors")


@query(
    "B18_payload_checks",
    f"""WITH {SESSIONS}
SELECT event_id, {_errs(("k < 10", "non_numeric:jitter"), ("value < 5", "non_numeric:cadence"))} AS errors,
  {_errs(("k >= 10 AND k/1e2 > 0.5", "out_of_range:jitter"), ("value >= 5 AND (value < 20 OR value > 250)", "out_of_range:cadence"))} AS warnings FROM sessions""",
)
def payload_checks(spark, sf):
    s = tb.sessions(spark, sf)
    raw = s.select(
        "event_id",
        F.when(F.col("k") < 10, "loud").otherwise((F.col("k") / 100.0).cast("string")).alias("jitter"),
        F.when(F.col("value") < 5, "slow").otherwise(F.col("value").cast("string")).alias("cadence"),
    )
    return dq.payload_checks(raw).select("event_id", "errors", "warnings")


@query(
    "B19_validate_versions",
    f"""SELECT o_orderkey, {_errs(("o_orderpriority IN ('1-URGENT')", "baseline_version"), ("o_orderstatus = 'P'", "algorithm_version"), ("o_orderpriority = '5-LOW'", "baseline_created_at"), ("o_totalprice < 200000", "sample_count"))} AS errors FROM orders""",
)
def validate_versions(spark, sf):
    o = tb.table(spark, sf, "orders")
    meta = o.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", "1.0").otherwise("1.0.3").alias("baseline_version"),
        F.when(F.col("o_orderstatus") != "P", "1.0.0").alias("algorithm_version"),
        F.when(F.col("o_orderpriority") == "5-LOW", "yesterday").otherwise(F.col("o_orderdate").cast("string")).alias("baseline_created_at"),
        F.col("o_orderdate").cast("string").alias("baseline_updated_at"),
        F.floor(F.col("o_totalprice") / 200000).alias("sample_count"),
    )
    return dq.validate_versions(meta).select("o_orderkey", "errors")
