"""Models of single modalities: fitted side by side, each on the present training rows alone."""

from pyspark.sql import functions as F
from test_training import rows, together  # noqa: F401

from driftwell.operators import modelling as md


def test_modalities_are_fitted_side_by_side(spark, rows, together):  # noqa: F811
    columns = {"one": ["a"], "two": ["b"]}
    got = md.single_modality_scores(rows, "y", columns, rounds=2).select("key", "p_one", "p_two").collect()
    assert together["all"] == 2 and together["most"] == 2
    want = rows.select("key", "present_one", "y", "a", "b")
    for m, cols in columns.items():
        model = md.boosted("y", cols, 2, 42).fit(rows.where((F.col("split") == "train") & (F.col(f"present_{m}") == 1)))
        want = md.probability(model, want).select(*want.columns, F.when(F.lit(m == "one") & (F.col("present_one") == 0), 0.5).otherwise(F.col("p")).alias(f"p_{m}"))
    assert {(r.key, round(r.p_one, 9), round(r.p_two, 9)) for r in got} == {(r.key, round(r.p_one, 9), round(r.p_two, 9)) for r in want.collect()}
    assert len(got) == 300
