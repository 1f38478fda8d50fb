import datetime as dt
import random

from pyspark.sql import functions as F

from driftwell.operators import privacy as pv
from driftwell.operators import sync as sy


def test_dedup_equals_the_queue_rule(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        s = rng.randint(0, 40)
        rows.append((i, f"s{s}", t0 + dt.timedelta(seconds=i), f"s{s}_{rng.randint(0, 2)}", rng.choice(["failed", "pending", "synced"])))
    df = spark.createDataFrame(rows, "id long, session_id string, timestamp timestamp, idempotency_key string, status string")
    got = {r["id"]: r["is_duplicate"] for r in sy.dedup_uploads(df).collect()}
    kept, want = [], {}
    for i, s, _, key, status in rows:
        want[i] = any(k == key or (x == s and st != "failed") for x, k, st in kept)
        if not want[i]:
            kept.append((s, key, status))
    assert got == want


def _in_order(rows):
    kept, want = [], {}
    for i, s, t, key, status in rows:
        key = key or (f"made {s} {t}" if s else None)
        want[i] = any((key and k == key) or (s and x == s and st != "failed") for x, k, st in kept)
        if not want[i]:
            kept.append((s, key, status))
    return want


QUEUE = "id long, session_id string, timestamp timestamp, idempotency_key string, status string"


def test_a_duplicate_blocks_nothing(spark):
    """The second upload was never queued, so its key is free for the third; rows without a key stay."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "S1", t0, "k1", "pending"), (2, "S1", t0, "k2", "pending"), (3, "S2", t0, "k2", "pending"), (4, "S3", t0, None, "pending"), (5, None, t0, None, None), (6, None, t0, "", "failed")]
    got = {r["id"]: r["is_duplicate"] for r in sy.dedup_uploads(spark.createDataFrame(rows, QUEUE)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert sy.dedup_uploads(spark.createDataFrame([], QUEUE)).count() == 0


def test_keys_across_sessions_equal_the_queue_in_order(spark):
    rng = random.Random(12)
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (i, rng.choice([None, "", *[f"s{x}" for x in range(25)]]), t0 + dt.timedelta(seconds=i // 2), rng.choice([None, "", *[f"k{x}" for x in range(30)]]), rng.choice(["failed", "failed", "pending", None]))
        for i in range(300)
    ]
    got = {r["id"]: r["is_duplicate"] for r in sy.dedup_uploads(spark.createDataFrame(rows, QUEUE)).collect()}
    assert got == _in_order(rows)


def test_a_chain_is_decided_link_by_link(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"s{(i + 1) // 2}", t0 + dt.timedelta(seconds=i), f"k{i // 2}", "pending") for i in range(12)]
    got = {r["id"]: r["is_duplicate"] for r in sy.dedup_uploads(spark.createDataFrame(rows, QUEUE)).collect()}
    assert got == _in_order(rows)


def test_server_wins_and_ignored_columns(spark):
    local = spark.createDataFrame([("a", 1.0, "x", False), ("b", 2.0, "y", False), ("c", None, "z", False)], "session_id string, value double, note string, synced boolean")
    server = spark.createDataFrame([("a", 1.0, "x", True), ("b", 9.0, "y", True)], "session_id string, value double, note string, synced boolean")
    got = {r["session_id"]: (r["resolution"], r["value"], r["divergent_fields"]) for r in sy.reconcile(local, server).collect()}
    assert got == {"a": ("idempotent_match", 1.0, []), "b": ("server_wins", 9.0, ["value"]), "c": ("local_inserted", None, [])}
    merged = sy.merge_sessions(local.unionByName(local), server)
    assert sorted(r["session_id"] for r in merged.collect()) == ["a", "b", "c"]


def test_failure_policy(spark):
    rows = [("Network request failed", None, 0), ("network", 403, 0), ("bad request timeout", None, 3), (None, 503, 4), (None, None, 0), ("odd", None, 0)]
    df = spark.createDataFrame(rows, "last_error string, status_code int, retry_count int")
    got = [(r["retryable"], r["next_status"]) for r in sy.classify_failures(df).collect()]
    assert got == [(True, "pending"), (False, "pending"), (False, "pending"), (True, "failed"), (False, "pending"), (False, "pending")]


def _log(spark, rows):
    return spark.createDataFrame(rows, "record_id long, participant_id long, consent_type string, consent_version string, granted boolean, timestamp timestamp, revoked_at timestamp")


def test_consent_gate_and_revocation(spark):
    t = dt.datetime(2024, 1, 1)
    log = _log(
        spark,
        [
            (1, 1, "data_collection", "1", True, t, None),
            (2, 1, "keyboard_access", "1", True, t, None),
            (3, 2, "data_collection", "1", True, t, None),
            (4, 2, "data_collection", "1", False, t + dt.timedelta(days=1), None),
            (5, 2, "keyboard_access", "1", True, t, None),
            (6, 3, "data_collection", "1", True, t, t + dt.timedelta(days=3)),
        ],
    )
    s = spark.createDataFrame([(1, "typing"), (1, "voice"), (1, "sleep"), (2, "typing"), (3, "sleep")], "participant_id long, modality string")
    assert sorted(map(tuple, pv.consented_sessions(s, log).select("participant_id", "modality").collect())) == [(1, "sleep"), (1, "typing")]
    req = spark.createDataFrame([(1, "all", t + dt.timedelta(days=5))], "participant_id long, consent_type string, requested_at timestamp")
    after = pv.apply_revocations(log, req)
    assert after.where("affected").count() == 2
    assert pv.consented_sessions(s, after.drop("affected")).count() == 0
    snap = {r["participant_id"]: r["data_collection"] for r in pv.consent_snapshot(log, ["data_collection"]).collect()}
    assert snap == {1: True, 2: False, 3: False}


def test_erasure_touches_only_the_requesting_participant(spark):
    tables = {n: spark.createDataFrame([(1, n), (1, n), (2, n)], "participant_id long, v string") for n in ("a", "b")}
    kept, counts = pv.erase(tables, spark.createDataFrame([(1,), (1,)], "participant_id long"))
    assert [df.select("participant_id").distinct().collect()[0][0] for df in kept.values()] == [2, 2]
    assert sorted(map(tuple, counts.select("table_name", "purged").collect())) == [("a", 2), ("b", 2)]


def test_erasure_keeps_consents_and_leaves_an_audit_record(spark):
    tables = {n: spark.createDataFrame([(1, n), (2, n)], "participant_id long, v string") for n in ("daily_features", "consent_records", "participants")}
    req = spark.createDataFrame([(1, dt.datetime(2024, 1, 5)), (1, dt.datetime(2024, 1, 3))], "participant_id long, requested_at timestamp")
    kept, counts = pv.erase(tables, req)
    assert {n: df.count() for n, df in kept.items()} == {"daily_features": 1, "consent_records": 2, "participants": 2}
    assert [tuple(r) for r in counts.collect()] == [(1, "daily_features", 1)]
    audit = pv.erasure_audit(req).collect()
    assert [(r["participant_id"], r["consent_type"], r["granted"], r["timestamp"], r["revoked_at"]) for r in audit] == [(1, "deletion", True, dt.datetime(2024, 1, 3), None)]


def test_export_holds_only_own_rows(spark):
    tables = {"a": spark.createDataFrame([(1, "x"), (2, "y")], "participant_id long, v string")}
    pack = pv.export_package(tables, spark.createDataFrame([(1,)], "participant_id long"))
    assert [r["record"] for r in pack.collect()] == ['{"participant_id":1,"v":"x"}']
    assert pv.export_summary(pack, ["a"]).first()["total_a"] == 1


def test_retention(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 3, 1),)], "date date")
    assert pv.expire(df, 30, "2024-03-15").count() == 1
    assert pv.expire(df, F.lit(90), "2024-03-15").count() == 2
