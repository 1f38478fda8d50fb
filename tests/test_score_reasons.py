"""Reasons and points of motor scores."""

from driftwell.operators import projections as pj


def test_walking_names_cadence_and_regularity_apart(spark):
    rows = [(1, 100.0, 0.1), (2, 20.0, 0.9), (3, 100.0, 0.9), (4, None, None)]
    walks = spark.createDataFrame(rows, "id int, cadence double, movement_regularity double").selectExpr(
        "*", "true as sensor_available", "30.0D as duration_seconds", "20 as step_count"
    )
    got = {r["id"]: r for r in pj.motor_quality(walks, "walking").collect()}
    assert got[1]["rejection_reasons"] == ["irregular"]
    assert got[2]["rejection_reasons"] == ["cadence_out_of_range"]
    assert got[4]["rejection_reasons"] == ["cadence_out_of_range", "irregular"]
    assert got[3]["rejection_reasons"] == [] and got[3]["quality"] == 1.0
    assert got[1]["breakdown"].asDict() == {"sensor_available": 0.3, "task_completed": 0.3, "sufficient_steps": 0.2, "signal_quality": 0.0}


def test_tremor_without_amplitude_is_not_called_movement(spark):
    rows = [(1, None), (2, 3.0), (3, 1.0)]
    holds = spark.createDataFrame(rows, "id int, tremor_amplitude double").selectExpr("*", "10.0D as duration_seconds", "60 as sample_count", "'ok' as extraction_status")
    got = {r["id"]: r for r in pj.motor_quality(holds, "tremor_hold").collect()}
    assert got[1]["rejection_reasons"] == ["no_amplitude", "artifact"]
    assert got[2]["rejection_reasons"] == ["moved"] and got[2]["quality"] == 0.7
    assert got[3]["rejection_reasons"] == []
