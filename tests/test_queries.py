"""Registered queries against their stated SQL on the smallest tables, and the properties of those without SQL."""

import inspect
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftwell import plans
from driftwell.operators import evaluation as ev
from driftwell.operators import modelling as md

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# One query per family here; tools/verify.py runs all of them.
CHOSEN = [
    "A4_decode_trials", "B7_cohort_integrity", "B11_trial_qc", "B16_leakage_report", "C6_model_inputs", "C11_visual_quality", "D4_walking_features",
    "D8_gait_features", "E8_disagreement", "E10_aggregate_day", "F4_baseline_row", "F9_adaptive_baseline", "G10_longitudinal", "H1_dedup_uploads",
    "H15_dashboard_summary", "I1_stratified_split", "I12_binary_metrics", "I16_missing_sweep", "J2_negation_scan",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _text(v):
    return "~" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, sf, con, name):
    df, rel = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(_text(r[c]) for c in cols) for r in df.collect())
    place = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(_text(r[i]) for i in place) for r in rel.fetchall())


def test_every_stated_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    own, stated = plans.load()  # without the corpus operators, which may be absent
    assert set(own) - set(stated) == {"I5_train_modality", "I6_single_modality_scores", "I7_concat_baseline", "I11_score_batch", "S5_streak_state"}


def test_plain_columns_only(spark, sf):
    allowed = {"bigint", "double", "boolean", "string"}
    for name in CHOSEN:
        assert {t for _, t in QUERIES[name](spark, sf).dtypes} <= allowed


def test_row_scores_are_one_stage_without_shuffle(spark, sf):
    for name in ("C7_sleep_score", "C9_voice_quality", "E1_quality_gate", "J1_phrase_scan"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_column_pruning_reaches_the_scan(spark, sf):
    plan = QUERIES["B5_split_overlap"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


@pytest.fixture(scope="module")
def cohort(spark):
    rows = spark.range(400).select(
        F.col("id").alias("pid"), (F.col("id") % 2).cast("int").alias("y"), (F.rand(1) + F.col("id") % 2).alias("a"), F.rand(2).alias("b"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(0).alias("present_m"), F.when(F.col("id") % 5 > 0, 1).otherwise(0).alias("present_n"),
    )
    return md.stratified_split(rows, "pid", "y").cache()


def test_split_is_stratified_and_disjoint(cohort):
    n = {(r["y"], r["split"]): r["count"] for r in cohort.groupBy("y", "split").count().collect()}
    assert n == {(y, s): c for y in (0, 1) for s, c in (("train", 140), ("val", 30), ("test", 30))}
    assert cohort.count() == cohort.select("pid").distinct().count() == 400


def test_training_picks_a_useful_model(cohort):
    model, report = md.train_modality(cohort, "pid", "y", ["a", "b"], folds=2, trees=5, rounds=3)
    assert len(report) == 3 and max(r[2] for r in report) > 0.95
    p = md.probability(model, cohort).where("split = 'test'")
    assert ev.binary_metrics(p, "y", "p").first()["roc_auc"] > 0.9


def test_absent_modality_scores_half_and_nothing_present_fails(cohort):
    cols = {"m": ["a"], "n": ["b"]}
    out = md.single_modality_scores(cohort, "y", cols, rounds=2)
    assert out.where("present_m = 0 AND p_m <> 0.5").count() == 0
    model, _ = md.train_modality(cohort, "pid", "y", ["a", "b"], folds=2, trees=2, rounds=1)
    got = {r["status"]: (r["n"], r["risks"]) for r in md.score_batch(cohort, model, ["m", "n"]).groupBy("status").agg(F.count("*").alias("n"), F.count("risk_score").alias("risks")).collect()}
    assert got["failed"][1] == 0 and got["success"][0] == got["success"][1]


def test_area_under_the_curve_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert ev.binary_metrics(df, "y", "s").first()["roc_auc"] == 0.625
    one = ev.binary_metrics(df.where("y = 1"), "y", "s").first()
    assert (one["roc_auc"], one["recall"]) == (0.5, 0.5)


def test_bootstrap_of_equal_models_is_zero(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 60).alias("s"))
    row = ev.bootstrap_auc_diff(df, "id", "y", "s", "s", n=50).first()
    assert (row["auc_diff_mean"], row["ci_lower"], row["ci_upper"], row["significant"]) == (0.0, 0.0, 0.0, False)


@pytest.mark.parametrize("name, operator", [("I5_train_modality", "train_modality"), ("I6_single_modality_scores", "single_modality_scores"), ("I7_concat_baseline", "concat_baseline")])
def test_training_queries_run_the_whole_job(spark, sf, monkeypatch, name, operator):
    """Folds, trees and rounds are those of the operator, over a split of all rows."""
    real, seen = getattr(md, operator), {}

    class Stop(Exception):
        pass

    def record(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Stop

    monkeypatch.setattr(md, operator, record)
    with pytest.raises(Stop):
        QUERIES[name](spark, sf)
    whole = {"folds": 5, "trees": 100, "rounds": 100}
    assert {k: seen[k] for k in whole if k in seen} == {k: whole[k] for k in whole if k in inspect.signature(real).parameters}
    rows = seen["df"].groupBy("split").count().collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert {r["split"] for r in rows} == {"train", "val", "test"} and sum(r["count"] for r in rows) == n


def test_early_fusion_query_leaves_the_base_rate(spark, sf):
    """Two or three rounds of step 0.05 keep all scores near the base rate; a hundred do not."""
    train = QUERIES["I7_concat_baseline"](spark, sf).where("split = 'train'").agg(F.min("p_concat").alias("low"), F.max("p_concat").alias("high")).first()
    assert train["low"] < 0.2 and train["high"] > 0.8


@pytest.mark.parametrize("name", ["C6_model_inputs_rest", "E10_aggregate_day_spread", "E11_daily_vector_features", "H13_export_package_sections"])
def test_whole_query_equals_its_sql(spark, sf, con, name):
    test_query_equals_its_sql(spark, sf, con, name)


def test_export_package_holds_eleven_sections(spark, sf):
    from driftwell.plans.sync_queries import SECTIONS

    found = {r["section"] for r in QUERIES["H13_export_package_sections"](spark, sf).select("section").distinct().collect()}
    assert found == set(SECTIONS) and len(SECTIONS) == 11


def test_gait_alone_is_a_motor_input_and_items_give_the_total(spark):
    from driftwell.operators import projections as pj

    df = spark.createDataFrame([(0.9, None, 1.0, [0, 1, 1]), (None, 3.0, None, None)], "step_regularity double, symmetry_index_pct double, ppe double, items array<int>")
    a, b = sorted(pj.map_to_model_inputs(df).collect(), key=lambda r: r["in_step_regularity"] is None)
    assert (a["available_inputs"], b["available_inputs"]) == (["motor", "rbd"], ["motor"])
    assert (a["in_step_regularity"], a["in_ppe"], a["in_rbdsq_total"], b["in_symmetry_index_pct"]) == (0.9, None, 2.0, 3.0)
    assert (a["in_item_responses"], a["in_age"], a["in_sex"]) == ([0] * 13, 65.0, "female")
