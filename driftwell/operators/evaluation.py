"""Metrics, curves, bootstrap, sweeps and attribution as aggregates over score tables."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.functions.numeric import round4, round_half_away
from driftwell.operators.orderstats import HOT, in_blocks


# Helpers of Python stages travel by value: workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score_counts(df: DataFrame, label: str, score: str, by: list[str], hot: int = HOT) -> DataFrame:
    """Positives and negatives per distinct score, with the running counts of lower scores.

    Groups of more than ``hot`` distinct scores are ranked inside blocks cut at their own quantiles, wherever the scores lie;
    prefix sums over block totals connect the blocks, so a large table is never ordered in one task.
    """
    per = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    per = in_blocks(per, by, "s", hot=hot)
    totals = per.groupBy(*by, "block").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    along = W.partitionBy(*by, F.lit(0)).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    prefix = totals.select(
        *by, "block", F.coalesce(F.sum("bp").over(along), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(along), F.lit(0)).alias("n0")
    )
    inside = W.partitionBy(*by, "block").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    return per.join(prefix, [*by, "block"]).select(
        *by,
        "s",
        "pos",
        "neg",
        (F.col("p0") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_below"),
        (F.col("n0") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_below"),
    )


def auc_expr() -> Column:
    """Mann-Whitney area from integer counts; 0.5 when a class is absent."""
    wins = F.sum(F.col("pos").cast("double") * (2 * F.col("neg_below") + F.col("neg")))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return F.when((p > 0) & (n > 0), wins / (2 * p * n)).otherwise(F.lit(0.5))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, score: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, area under the curve, confusion counts, sample count and share of positives. A
    zero denominator gives 0."""
    by = by or []
    c = score_counts(df, label, score, by)
    high = F.col("s") >= threshold
    g = c.groupBy(*by).agg(
        F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(high, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~high, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(~high, F.col("pos")).otherwise(0)).alias("fn"),
        auc_expr().alias("auc"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return g.select(
        *by,
        *("tp", "fp", "tn", "fn"),
        round4(_ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"),
        round4(_ratio(tp, tp + fp)).alias("precision"),
        round4(_ratio(tp, tp + fn)).alias("recall"),
        round4(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        round4(F.col("auc")).alias("roc_auc"),
        (tp + fp + tn + fn).alias("n_samples"),
        round4(_ratio(tp + fn, tp + fp + tn + fn)).alias("class_balance"),
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    c = score_counts(df, label, score, [])
    totals = df.where(F.col(score).isNotNull()).agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) == 0).alias("N")).first()
    p, n = float(totals["P"]), float(totals["N"])
    return c.select(
        F.col("s").alias("threshold"),
        round4((F.lit(n) - F.col("neg_below")) / max(n, 1.0)).alias("fpr"),
        round4((F.lit(p) - F.col("pos_below")) / max(p, 1.0)).alias("tpr"),
    )


def calibration(df: DataFrame, label: str, score: str, bins: int = 8) -> DataFrame:
    """Mean prediction, observed rate and size per uniform bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    g = df.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("y"), F.avg(score).alias("p")
    )
    return g.select("bin", "n", round4(F.col("y")).alias("fraction_positive"), round4(F.col("p")).alias("mean_predicted"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.agg(round4(F.avg(d * d)).alias("brier"))


# ---- bootstrap -------------------------------------------------------------------------------------------------

def poisson_cdf(steps: int = 9) -> np.ndarray:
    """Cumulative Poisson(1) probabilities of 0, 1, ...: a uniform number weighs as many as it reaches."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(steps)])


def uniforms(key: Column, n: int, seed: int) -> Column:
    """One number in [0, 1) per replicate, hashed from key, replicate and seed: the same however data is partitioned."""

    def draw(rep: Column) -> Column:
        text = F.concat_ws(":", key.cast("string"), rep.cast("string"), F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)

    return F.transform(F.sequence(F.lit(1), F.lit(n)), draw)


def _tally(batches: Iterator[pd.DataFrame], n: int, rows: int = 256) -> Iterator[pd.DataFrame]:
    """Counters of all replicates over one range of scores, read in order.

    Per model: the first and the last score of the range as borders, because other ranges may share them, and everything between
    as one segment with the wins inside it.
    """
    cdf = poisson_cdf()
    out, model, opened, closed, segment = [], None, None, 0, None

    def close() -> None:
        nonlocal closed, segment
        s, pos, neg = opened
        if not closed:
            out.append((model, s, 0, pos, neg, np.zeros(n)))
        else:
            low, p, q, wins = segment or (s, 0, 0, 0.0)
            segment = (low, p + pos, q + neg, wins + pos * (2.0 * q + neg))
        closed += 1

    def finish() -> None:
        if opened is not None:
            out.append((model, opened[0], 0, *opened[1:], np.zeros(n)))
            if segment is not None:
                out.append((model, segment[0], 1, *segment[1:]))

    for pdf in batches:
        for at in range(0, len(pdf), rows):
            part = pdf.iloc[at : at + rows]
            m, s, y = part["model"].to_numpy(), part["s"].to_numpy(), part["y"].to_numpy()
            w = np.searchsorted(cdf, np.stack(part["u"].to_numpy()), side="right")
            starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (s[1:] != s[:-1])])
            pos, neg = (np.add.reduceat(w * (y == label)[:, None], starts) for label in (1, 0))
            for i, p, q in zip(starts, pos, neg, strict=True):
                if opened is not None and model == m[i] and opened[0] == s[i]:
                    opened = (opened[0], opened[1] + p, opened[2] + q)
                    continue
                if model == m[i]:
                    close()
                else:
                    finish()
                    model, closed, segment = m[i], 0, None
                opened = (s[i], p, q)
    finish()
    yield pd.DataFrame(out, columns=["model", "s", "segment", "pos", "neg", "wins"])


def bootstrap_auc_diff(df: DataFrame, key: str, label: str, score_a: str, score_b: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of AUC(a) - AUC(b) over ``n`` Poisson resamples.

    Rows are cut into ranges of (model, score, hash of key), so a score that many rows share is spread over several. A task reads its
    range once and holds an array of counters for all replicates; at most three rows of counters per range and model go
    on to the prefix sums over ranges. Scores are compared as they are: rounding them would make ties. A null score is
    the lowest, not-a-number the highest; a null label counts in neither class; a replicate without both classes drops out.
    """
    def score(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(-math.inf))
        return F.when(F.isnan(v), F.lit(math.inf)).otherwise(v)

    models = F.array(*[F.struct(F.lit(m).alias("model"), score(c).alias("s")) for m, c in (("a", score_a), ("b", score_b))])
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(label).cast("double"), F.lit(-1.0)).alias("y"), F.inline(models)).withColumn("salt", F.xxhash64("key"))
    # As many ranges as the session has shuffle partitions: hashing n times per row is worth a task for few bytes.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "model", "s", "salt").sortWithinPartitions("model", "s").select("model", "s", "y", uniforms(F.col("key"), n, seed).alias("u"))
    counted = ordered.mapInPandas(lambda batches: _tally(batches, n), "model string, s double, segment int, pos array<long>, neg array<long>, wins array<double>")
    per = counted.select("model", "s", "segment", F.posexplode(F.arrays_zip("pos", "neg", "wins")).alias("rep", "c")).groupBy("rep", "model", "s", "segment").agg(
        *[F.sum(f"c.{c}").alias(c) for c in ("pos", "neg", "wins")]
    )
    below = W.partitionBy("rep", "model").orderBy("s").rowsBetween(W.unboundedPreceding, -1)  # at most three rows per range
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    inside = F.when(F.col("segment") == 1, F.col("wins")).otherwise(pos * neg)
    per = per.withColumn("won", inside + 2 * pos * F.coalesce(F.sum("neg").over(below), F.lit(0)))
    auc = per.groupBy("rep", "model").agg(F.sum("won").alias("won"), F.sum(pos).alias("p"), F.sum(neg).alias("m")).where("p > 0 AND m > 0")
    auc = auc.select("rep", "model", (F.col("won") / (2 * F.col("p") * F.col("m"))).alias("auc"))
    diff = auc.groupBy("rep").agg((F.max(F.when(F.col("model") == "a", F.col("auc"))) - F.max(F.when(F.col("model") == "b", F.col("auc")))).alias("d"))
    g = diff.agg(F.avg("d").alias("m"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count("d").alias("replicates"))
    zero = F.lit(0.0)
    return g.select(
        "replicates",
        round4(F.coalesce("m", zero)).alias("auc_diff_mean"),
        round4(F.coalesce(F.get("ci", F.lit(0)), zero)).alias("ci_lower"),
        round4(F.coalesce(F.get("ci", F.lit(1)), zero)).alias("ci_upper"),
    ).withColumn("significant", F.col("ci_lower") > 0)


# ---- fusion on score tables ------------------------------------------------------------------------------------

def weighted_average(scores: DataFrame, key: str) -> DataFrame:
    """Late fusion of a long score table (key, modality, p, present): mean over the present modalities, 0 if none is
    present."""
    n = F.sum(F.col("present"))
    return scores.groupBy(key).agg((F.sum(F.col("p") * F.col("present")) / F.greatest(n, F.lit(1))).alias("fused"), n.alias("n_present"))


def gate_weights(scores: DataFrame, key: str, n_modalities: int = 5) -> DataFrame:
    """Masked softmax over the modality scores of a sample; with none present every weight is 1/n. A sample has one row
    per modality, so the window is tiny."""
    w = W.partitionBy(key)
    s = F.when(F.col("present") == 1, F.col("score"))
    e = F.when(s.isNotNull(), F.exp(s - F.max(s).over(w))).otherwise(F.lit(0.0))
    total = F.sum("_e").over(w)
    return scores.withColumn("_e", e).withColumn("weight", F.when(total > 0, F.col("_e") / total).otherwise(F.lit(1.0 / n_modalities))).drop("_e")


def gate_summary(weights: DataFrame) -> DataFrame:
    return weights.groupBy("modality").agg(
        round4(F.avg("weight")).alias("average_weight"), round4(1 - F.avg(F.col("present").cast("double"))).alias("missing_rate")
    )


def scenarios(modalities: list[str]) -> list[tuple[str, list[str]]]:
    """The 19 availability patterns of the sweep, each with its active modalities."""
    out = [("all", list(modalities))]
    out += [(f"missing_{m}", [x for x in modalities if x != m]) for m in modalities]
    pairs = [("retina", "voice"), ("retina", "motor"), ("voice", "motor"), ("olfactory", "rbd"), ("retina", "olfactory")]
    triples = [("retina", "voice", "motor"), ("olfactory", "rbd", "retina"), ("olfactory", "rbd", "voice")]
    out += [("missing_" + "_and_".join(g), [x for x in modalities if x not in g]) for g in (*pairs, *triples)]
    out += [(f"only_{m}", [m]) for m in modalities]
    return out


def missing_sweep(wide: DataFrame, label: str, modalities: list[str]) -> DataFrame:
    """Metrics of the present-modality mean under every scenario and the drop against all modalities.

    ``wide`` has p_<m> and present_<m>. Scenarios are a constant array exploded next to each row: one scan, one
    aggregation keyed by scenario.
    """
    table = scenarios(modalities)
    arr = F.array(
        *[F.struct(F.lit(name).alias("scenario"), *[F.lit(int(m in active)).alias(f"on_{m}") for m in modalities]) for name, active in table]
    )
    rows = wide.select("*", F.inline(arr))
    on = {m: F.col(f"on_{m}") * F.col(f"present_{m}") for m in modalities}
    num = sum((F.col(f"p_{m}") * on[m] for m in modalities[1:]), F.col(f"p_{modalities[0]}") * on[modalities[0]])
    den = sum((on[m] for m in modalities[1:]), on[modalities[0]])
    scored = rows.select("scenario", label, F.when(den > 0, num / den).otherwise(F.lit(0.5)).alias("score"))
    m = binary_metrics(scored, label, "score", ["scenario"]).select("scenario", "roc_auc", "f1")
    whole = W.partitionBy(F.lit(0))  # one row per scenario
    best = {c: F.max(F.when(F.col("scenario") == "all", F.col(c))).over(whole) for c in ("roc_auc", "f1")}
    return m.select("scenario", "roc_auc", "f1", round4(best["roc_auc"] - F.col("roc_auc")).alias("auc_drop"), round4(best["f1"] - F.col("f1")).alias("f1_drop"))


# ---- attribution -----------------------------------------------------------------------------------------------

FUSION_MODALITIES = ["olfactory", "rbd", "voice", "motor", "retina"]
GATED_DIMS, DEMO_DIMS = 32, 8


def feature_group(index: Column, gated: int = GATED_DIMS) -> Column:
    """Group of a fused-vector position: gated representation (of ``gated`` dimensions), demographics, or the presence flag
    of a modality."""
    presence = [F.when(index == gated + DEMO_DIMS + i, F.lit(f"presence_{m}")) for i, m in enumerate(FUSION_MODALITIES)]
    return F.coalesce(F.when(index < gated, "gated"), F.when(index < gated + DEMO_DIMS, "demographic"), *presence)


def global_importance(shap: DataFrame, gated: int = GATED_DIMS) -> DataFrame:
    g = shap.groupBy("feature_index").agg(F.avg(F.abs("shap_value")).alias("m"))
    ranked = g.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("m"), "feature_index")))
    return ranked.select("feature_index", feature_group(F.col("feature_index"), gated).alias("feature_group"), round_half_away(F.col("m"), 6).alias("mean_abs_shap"), "rank")


def modality_importance(shap: DataFrame, gates: DataFrame, gated: int = GATED_DIMS) -> DataFrame:
    """Share per modality: its presence-flag attribution plus the gated part split by the normalised average gate
    weight; demographics on their own. All tables after the first aggregate have at most six rows."""
    per = shap.groupBy("feature_index").agg(F.avg(F.abs("shap_value")).alias("m")).withColumn("grp", feature_group(F.col("feature_index"), gated))
    groups = per.groupBy("grp").agg(F.sum("m").alias("m"))
    avg = gates.groupBy("modality").agg(F.avg("weight").alias("w"))
    share = avg.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(F.lit(0))))
    whole_gated = F.max(F.when(F.col("grp") == "gated", F.col("m"))).over(W.partitionBy(F.lit(0)))
    flags = groups.withColumn("g", whole_gated).where("grp LIKE 'presence%'").select(F.substring("grp", 10, 20).alias("modality"), F.col("m").alias("flag"), "g")
    mods = flags.join(share, "modality").select("modality", (F.col("flag") + F.col("g") * F.col("share")).alias("total"))
    demo = groups.where("grp = 'demographic'").select(F.lit("demographic_covariates").alias("modality"), F.col("m").alias("total"))
    both = mods.unionByName(demo)
    whole = F.sum("total").over(W.partitionBy(F.lit(0)))
    return both.select("modality", round_half_away(F.col("total"), 6).alias("mean_abs_shap"), round_half_away(100.0 * F.col("total") / whole, 2).alias("percent"))


def local_contributors(shap: DataFrame, k: int = 5) -> DataFrame:
    """Per sample the k strongest positive and negative features; a sample has 45 rows, so the window is bounded."""
    v = F.col("shap_value")
    sign = F.when(v > 0, "positive").when(v < 0, "negative")
    ranked = shap.withColumn("direction", sign).where(F.col("direction").isNotNull()).withColumn(
        "rank", F.row_number().over(W.partitionBy("sample_id", "direction").orderBy(F.desc(F.abs("shap_value")), "feature_index"))
    )
    return ranked.where(F.col("rank") <= k).select("sample_id", "direction", "rank", "feature_index", round_half_away(v, 6).alias("shap_value"))


def net_direction(shap: DataFrame, eps: float = 1e-6, gated: int = GATED_DIMS) -> DataFrame:
    g = shap.groupBy("sample_id", feature_group(F.col("feature_index"), gated).alias("feature_group")).agg(F.sum("shap_value").alias("net"))
    return g.select("sample_id", "feature_group", F.when(F.col("net") > eps, "positive").when(F.col("net") < -eps, "negative").otherwise("mixed").alias("direction"))


def stability(runs: DataFrame, key: str, value: str, tolerance: float = 1e-5) -> DataFrame:
    """Spread of repeated runs per id and whether it stays within the tolerance."""
    g = runs.groupBy(key).agg((F.max(value) - F.min(value)).alias("spread"), F.count(F.lit(1)).alias("runs"))
    return g.withColumn("stable", F.col("spread") <= tolerance)
