"""Splits, preprocessing, MLlib training and batch scoring."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.functions.numeric import clamp, round4
from driftwell.operators import orderstats as osx

BUCKETS = 4096
#: Rows of a partition of training rows; models fitted at once.
ROWS, AT_ONCE = 20_000, 8


def hash32(key: Column, seed: int) -> Column:
    """Unsigned 32-bit hash of an id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def hashed_positions(ids: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Zero-based position of each id in hash order within its label, and the label's size.

    Ranking runs inside 4,096 hash buckets per label, connected by prefix sums of bucket sizes; a label with half of all
    ids is spread over as many partitions.
    """
    h = hash32(F.col(key), seed)
    d = ids.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / float(2**32 // BUCKETS)))
    sizes = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by = W.partitionBy(label)
    prefix = sizes.select(
        label,
        "_b",
        F.coalesce(F.sum("_c").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(by).alias("n"),
    )
    rn = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key))
    return d.withColumn("_rn", rn).join(prefix, [label, "_b"]).select(key, label, (F.col("_before") + F.col("_rn") - 1).alias("position"), "n")


def stratified_split(df: DataFrame, key: str, label: str, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Adds ``split``: every row of a participant in one split, each label divided by the ratios to within one id.

    A participant with several labels counts under its most frequent one (smallest on a tie).
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    votes = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("_v"))
    ids = votes.groupBy(key).agg(F.min_by(F.col(label), F.struct(-F.col("_v"), F.col(label))).alias("_label"))
    pos = hashed_positions(ids, key, "_label", seed)
    train = F.floor(F.col("n") * ratios[0] + 0.5)
    val = F.floor(F.col("n") * (ratios[0] + ratios[1]) + 0.5)
    split = F.when(F.col("position") < train, "train").when(F.col("position") < val, "val").otherwise("test")
    return df.join(pos.select(key, split.alias("split")), key)


# ---- preprocessing on the long table (id, modality, feature, value) --------------------------------------------

def fit_preprocessors(train: DataFrame) -> DataFrame:
    """Per feature: exact training median, then mean and population deviation of the imputed values.

    A feature's value counts are bounded by the four-to-six-decimal grid, not by the rows.
    """
    keys = ["modality", "feature"]
    counts = osx.value_counts(train, keys, F.col("value"))
    median = osx.ranked(counts, keys).groupBy(*keys).agg(osx.median_expr().alias("median"))
    rows = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("known"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    p = median.join(rows, keys)
    gap = F.col("rows") - F.col("known")
    mean = (F.col("s") + gap * F.col("median")) / F.col("rows")
    square = (F.col("ss") + gap * F.col("median") * F.col("median")) / F.col("rows")
    sd = F.sqrt(F.greatest(square - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return p.withColumn("mean", mean).select(*keys, "median", "mean", F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("std"))


def _scaled() -> Column:
    return (F.coalesce("value", "median") - F.col("mean")) / F.col("std")


def transform(df: DataFrame, params: DataFrame) -> DataFrame:
    """Imputed and scaled value; 0 for every feature of an absent modality. Parameters are one row per feature; their size decides the
    join."""
    j = df.join(params, ["modality", "feature"])
    return j.withColumn("z", F.when(F.col("present") == 1, _scaled()).otherwise(F.lit(0.0))).drop("median", "mean", "std")


def normalize_frozen(df: DataFrame, params: DataFrame, limit: float = 5.0) -> DataFrame:
    """Scaling with stored parameters, clipped to +-5; nothing is fitted."""
    j = df.join(params, ["modality", "feature"])
    return j.withColumn("z", clamp(_scaled(), -limit, limit)).drop("median", "mean", "std")


def presence(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """1 for a modality with any value; absent demographics become 65 and female."""
    flags = {f"present_{m}": F.when(F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull(), 1).otherwise(0) for m, cols in columns.items()}
    out = df.withColumns(flags)
    if "age" in df.columns:
        out = out.withColumn("age", F.coalesce(F.col("age").cast("double"), F.lit(65.0)))
    if "sex" in df.columns:
        out = out.withColumn("sex", F.coalesce("sex", F.lit("female")))
    return out


# ---- training --------------------------------------------------------------------------------------------------

def candidates(label: str, seed: int = 42, trees: int = 100, rounds: int = 100) -> dict:
    shared = {"featuresCol": "features", "labelCol": label}
    return {
        "logistic_regression": LogisticRegression(maxIter=100, **shared),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=5, seed=seed, **shared),
        "boosted_trees": GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.05, seed=seed, **shared),
    }


def feature_stages(columns: list[str]) -> list:
    filled = [f"{c}__filled" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]


def with_folds(df: DataFrame, key: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """Stratified fold number per id: its position in hash order within the label, modulo the number of folds."""
    ids = df.select(key, label).distinct()
    pos = hashed_positions(ids, key, label, seed)
    return df.join(pos.select(key, (F.col("position") % folds).cast("int").alias("fold")), key)


def dealt(df: DataFrame) -> DataFrame:
    """The rows, cached in partitions of about ``ROWS`` by their hash, at most one per core.

    A fit passes over its rows hundreds of times: they are read and split once, and a file of few row groups keeps all cores busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-df.count() // ROWS))), F.xxhash64(*df.columns)).cache()


def at_once(spark: SparkSession, calls: list[Callable], most: int = AT_ONCE) -> list:
    """Results of ``calls`` in their order, ``most`` of them running at once.

    A boosted model is some hundred short jobs, one after the other, that leave most cores idle; the jobs of several models fill them.
    """
    with ThreadPool(max(1, min(most, len(calls)))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(spark)(call) for call in calls], chunksize=1)


def train_modality(df: DataFrame, key: str, label: str, columns: list[str], folds: int = 5, seed: int = 42, trees: int = 100, rounds: int = 100, split: str = "split"):
    """Fits every candidate on the training rows; returns (best pipeline model, report rows).

    Cross-validated area under the curve is reported; the best validation area wins.  All candidates and folds are fitted side by side.
    """
    rows = df.select(key, label, split, *columns)
    train = dealt(with_folds(rows.where(F.col(split) == "train"), key, label, folds, seed))
    val = dealt(rows.where(F.col(split) == "val"))
    filled = {r["fold"] for r in train.select("fold").distinct().collect()}
    if filled != set(range(folds)) or folds < 2:
        raise ValueError(f"every one of {folds} folds needs rows; filled are {sorted(filled)}")
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")

    def fitted(estimator, fold: int | None):
        """(area on the fold that is left out, or on the validation rows; model)."""
        seen, unseen = (train, val) if fold is None else (train.where(F.col("fold") != fold), train.where(F.col("fold") == fold))
        model = Pipeline(stages=[*feature_stages(columns), estimator]).fit(seen)
        return evaluator.evaluate(model.transform(unseen)), model

    try:
        # The boosted trees take longest and begin first.
        tasks = [(name, estimator, fold) for name, estimator in reversed(candidates(label, seed, trees, rounds).items()) for fold in (None, *range(folds))]
        found = at_once(df.sparkSession, [lambda e=estimator, f=fold: fitted(e, f) for _, estimator, fold in tasks])
    finally:
        train.unpersist()
        val.unpersist()
    best, report = None, []
    for name in candidates(label):
        areas = {fold: one for (of, _, fold), one in zip(tasks, found, strict=True) if of == name}
        area, model = areas.pop(None)
        report.append((name, sum(a for a, _ in areas.values()) / folds, float(area)))
        if best is None or area > best[0]:
            best = (area, model)
    return best[1], report


def probability(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def boosted(label: str, columns: list[str], rounds: int, seed: int) -> Pipeline:
    return Pipeline(stages=[*feature_stages(columns), GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=3, stepSize=0.05, seed=seed)])


def single_modality_scores(df: DataFrame, label: str, columns: dict[str, list[str]], rounds: int = 100, seed: int = 42) -> DataFrame:
    """One boosted model per modality, fitted on its present training rows; an absent modality scores 0.5. The models are fitted side by side."""
    flags = [f"present_{m}" for m in columns]
    needed = list(dict.fromkeys([label, *flags, *[c for cols in columns.values() for c in cols]]))
    train = dealt(df.where(F.col("split") == "train").select(*needed))
    try:
        models = at_once(df.sparkSession, [lambda m=m, cols=cols: boosted(label, cols, rounds, seed).fit(train.where(F.col(f"present_{m}") == 1)) for m, cols in columns.items()])
    finally:
        train.unpersist()
    out = df
    for m, model in zip(columns, models, strict=True):
        scored = probability(model, out)
        out = scored.select(*out.columns, F.when(F.col(f"present_{m}") == 1, F.col("p")).otherwise(F.lit(0.5)).alias(f"p_{m}"))
    return out


def concat_baseline(df: DataFrame, label: str, columns: dict[str, list[str]], extra: list[str], rounds: int = 100, seed: int = 42) -> DataFrame:
    """Early fusion: all features, presence flags and demographics in one boosted model."""
    flags = [f"present_{m}" for m in columns]
    numeric = df.withColumns({c: F.col(c).cast("double") for c in [*flags, *extra]})
    cols = [c for cs in columns.values() for c in cs] + flags + extra
    train = dealt(numeric.where(F.col("split") == "train").select(*dict.fromkeys([label, *cols])))
    try:
        model = boosted(label, cols, rounds, seed).fit(train)
    finally:
        train.unpersist()
    return probability(model, numeric).select(*df.columns, F.col("p").alias("p_concat"))


def score_batch(df: DataFrame, model, modalities: list[str]) -> DataFrame:
    """Risk and status of every row in one pass: success, partial_success, or failed with a null risk."""
    present = sum((F.col(f"present_{m}") for m in modalities[1:]), F.col(f"present_{modalities[0]}"))
    scored = probability(model, df).withColumn("n_present", present)
    status = F.when(F.col("n_present") == 0, "failed").when(F.col("n_present") == len(modalities), "success").otherwise("partial_success")
    return scored.select(*df.columns, "n_present", status.alias("status"), F.when(F.col("n_present") > 0, round4(clamp(F.col("p"), 0, 1))).alias("risk_score"))

