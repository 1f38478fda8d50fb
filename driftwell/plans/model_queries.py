"""I: modelling and evaluation. Embeddings are the cohort (five blocks of dimensions = modalities), orders a score table."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from driftwell.functions.numeric import round4
from driftwell.operators import evaluation as ev
from driftwell.operators import modelling as md
from driftwell.plans import tables as tb
from driftwell.plans.registry import query
from driftwell.plans.sqltext import mdn, r4, rn

MODS = ev.FUSION_MODALITIES
# Modality -> first and last embedding dimension.
BLOCKS = {"olfactory": (0, 12), "rbd": (13, 25), "voice": (26, 38), "motor": (39, 51), "retina": (52, 63)}


def _present(i: int) -> str:
    return f"CASE WHEN (vec_id*7 + {i}*3) % 5 <> 0 THEN 1 ELSE 0 END"


def cohort(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    flags = [F.expr(_present(i)).alias(f"present_{m}") for i, m in enumerate(MODS)]
    return e.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), "embedding", *flags)


def long_cohort(spark, sf):
    """(vec_id, y, modality, feature, value, present); values of an absent modality are null."""
    c = cohort(spark, sf)
    f = F.col("feature")
    x = c.select("vec_id", "y", *[f"present_{m}" for m in MODS], F.posexplode("embedding").alias("feature", "raw"))
    modality = F.coalesce(*[F.when(f.between(a, b), F.lit(m)) for m, (a, b) in BLOCKS.items()])
    present = F.coalesce(*[F.when(f.between(a, b), F.col(f"present_{m}")) for m, (a, b) in BLOCKS.items()])
    return x.select("vec_id", "y", modality.alias("modality"), "feature", F.when(present == 1, F.col("raw").cast("double")).alias("value"), present.alias("present"))


_mod_case = "CASE " + " ".join(f"WHEN feature <= {b} THEN '{m}'" for m, (_, b) in BLOCKS.items()) + " END"
_pres_case = "CASE " + " ".join(f"WHEN feature <= {b} THEN {_present(i)}" for i, (_, (_, b)) in enumerate(BLOCKS.items())) + " END"
LONG = f"""x AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, unnest(range(64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings),
lc AS (SELECT vec_id, y, feature, {_mod_case} AS modality, {_pres_case} AS present, CASE WHEN {_pres_case} = 1 THEN raw END AS value FROM x)"""


def _h32(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


SPLIT = f"""ids AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings),
pos AS (SELECT vec_id, y, row_number() OVER (PARTITION BY y ORDER BY {_h32("vec_id")}, vec_id) - 1 AS p, count(*) OVER (PARTITION BY y) AS n FROM ids),
split AS (SELECT vec_id, y, CASE WHEN p < floor(n*0.7::DOUBLE+0.5) THEN 'train' WHEN p < floor(n*(0.7::DOUBLE+0.15::DOUBLE)+0.5) THEN 'val' ELSE 'test' END AS split FROM pos)"""


@query("I1_stratified_split", f"WITH {SPLIT} SELECT vec_id, CAST(y AS BIGINT) AS y, split FROM split")
def stratified_split(spark, sf):
    return md.stratified_split(cohort(spark, sf).select("vec_id", "y"), "vec_id", "y")


def _train_long(spark, sf):
    lc = long_cohort(spark, sf)
    ids = md.stratified_split(cohort(spark, sf).select("vec_id", "y"), "vec_id", "y").where("split = 'train'")
    return lc.join(ids.select("vec_id"), "vec_id", "left_semi")


PARAMS = f"""{LONG}, {SPLIT}, tr AS (SELECT lc.* FROM lc JOIN split USING (vec_id) WHERE split = 'train'),
md AS (SELECT modality, feature, {mdn('value', ' FILTER (value IS NOT NULL)')} AS median FROM tr GROUP BY ALL),
pa AS (SELECT modality, feature, md.median, avg(coalesce(value, md.median)) AS mean, stddev_pop(coalesce(value, md.median)) AS std FROM tr JOIN md USING (modality, feature) GROUP BY ALL)"""


@query("I2_fit_preprocessors", f"WITH {PARAMS} SELECT modality, feature, {r4('median')} AS median, {r4('mean')} AS mean, {r4('std')} AS std FROM pa")
def fit_preprocessors(spark, sf):
    p = md.fit_preprocessors(_train_long(spark, sf))
    return p.select("modality", "feature", *[round4(F.col(c)).alias(c) for c in ("median", "mean", "std")])


@query("I3_transform", f"WITH {PARAMS} SELECT vec_id, modality, feature, CASE WHEN present = 1 THEN {rn('((coalesce(value, median)-mean)/std)', 3)} ELSE 0e0 END AS z FROM lc JOIN pa USING (modality, feature)")
def transform(spark, sf):
    z = md.transform(long_cohort(spark, sf), md.fit_preprocessors(_train_long(spark, sf)))
    return z.select("vec_id", "modality", "feature", _r3("z").alias("z"))


def _r3(c):
    from driftwell.functions.numeric import round_half_away

    return round_half_away(F.col(c), 3)


# Stored parameters far narrower than the data, so that the clip is exercised.
@query("I4_normalize_frozen", f"WITH {LONG} SELECT vec_id, modality, feature, {rn('least(greatest((coalesce(value, 0.01::DOUBLE)-0.01::DOUBLE)/0.03::DOUBLE, -5e0), 5e0)', 3)} AS z FROM lc")
def normalize_frozen(spark, sf):
    lc = long_cohort(spark, sf)
    params = lc.groupBy("modality", "feature").agg(F.lit(0.01).alias("median"), F.lit(0.01).alias("mean"), F.lit(0.03).alias("std"))
    return md.normalize_frozen(lc, params).select("vec_id", "modality", "feature", _r3("z").alias("z"))


def _features(spark, sf, split=True):
    c = cohort(spark, sf)
    cols = {m: [f"{m}_{j}" for j in range(a, b + 1)] for m, (a, b) in BLOCKS.items()}
    wide = c.select(
        "vec_id", "y", *[f"present_{m}" for m in MODS],
        *[F.when(F.col(f"present_{m}") == 1, F.col("embedding")[j].cast("double")).alias(f"{m}_{j}") for m, (a, b) in BLOCKS.items() for j in range(a, b + 1)],
    )
    if split:
        wide = md.stratified_split(wide, "vec_id", "y")
    return wide, cols


# Training queries run the operators with their own folds, trees and rounds.
@query("I5_train_modality")
def train_modality(spark, sf):
    wide, cols = _features(spark, sf)
    model, report = md.train_modality(wide, "vec_id", "y", cols["voice"])
    best = max(report, key=lambda r: r[2])[0]
    scored = md.probability(model, wide)
    return scored.select("vec_id", "split", F.lit(best).alias("winner"), round4(F.col("p")).alias("p"))


@query("I6_single_modality_scores")
def single_modality(spark, sf):
    wide, cols = _features(spark, sf)
    out = md.single_modality_scores(wide, "y", cols)
    return out.select("vec_id", "split", *[round4(F.col(f"p_{m}")).alias(f"p_{m}") for m in MODS])


@query("I7_concat_baseline")
def concat_baseline(spark, sf):
    wide, cols = _features(spark, sf)
    return md.concat_baseline(wide, "y", cols, []).select("vec_id", "split", round4(F.col("p_concat")).alias("p_concat"))


def _scores(spark, sf):
    """Long table of one pseudo-probability per modality: (1 + mean of the dimensions of its block) / 2."""
    c = cohort(spark, sf)
    rows = [
        F.struct(F.lit(m).alias("modality"), ((1 + sum((F.col("embedding")[j].cast("double") for j in range(a + 1, b + 1)), F.col("embedding")[a].cast("double")) / (b - a + 1)) / 2).alias("p"), F.col(f"present_{m}").alias("present"))
        for m, (a, b) in BLOCKS.items()
    ]
    return c.select("vec_id", "y", F.inline(F.array(*rows)))


SCORES = "sc AS (" + " UNION ALL ".join(
    f"SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, '{m}' AS modality, (1+({'+'.join(f'CAST(embedding[{j + 1}] AS DOUBLE)' for j in range(a, b + 1))})/{b - a + 1})/2 AS p, {_present(i)} AS present FROM embeddings"
    for i, (m, (a, b)) in enumerate(BLOCKS.items())
) + ")"


@query("I8_weighted_average", f"WITH {SCORES} SELECT vec_id, CAST(sum(present) AS BIGINT) AS n_present, {r4('(sum(p*present)/greatest(sum(present), 1))')} AS fused FROM sc GROUP BY vec_id")
def weighted_average(spark, sf):
    return ev.weighted_average(_scores(spark, sf), "vec_id").select("vec_id", "n_present", round4(F.col("fused")).alias("fused"))


GATES = f"""{SCORES}, ge AS (SELECT *, CASE WHEN present = 1 THEN exp(p - max(CASE WHEN present = 1 THEN p END) OVER (PARTITION BY vec_id)) ELSE 0e0 END AS e FROM sc),
gw AS (SELECT *, CASE WHEN sum(e) OVER (PARTITION BY vec_id) > 0 THEN e/sum(e) OVER (PARTITION BY vec_id) ELSE 0.2::DOUBLE END AS weight FROM ge)"""


def _gates(spark, sf):
    return ev.gate_weights(_scores(spark, sf).withColumn("score", F.col("p")), "vec_id")


@query("I9_gate_weights", f"WITH {GATES} SELECT vec_id, modality, {r4('weight')} AS weight FROM gw")
def gate_weights(spark, sf):
    return _gates(spark, sf).select("vec_id", "modality", round4(F.col("weight")).alias("weight"))


@query("I10_presence", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'F' OR o_totalprice > 100000 THEN 1 ELSE 0 END AS BIGINT) AS present_voice, CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS present_motor, CASE WHEN o_totalprice > 400000 THEN o_totalprice/1e4 ELSE 6.5e1 END AS age, CASE WHEN o_orderstatus = 'O' THEN 'male' ELSE 'female' END AS sex FROM orders")
def presence(spark, sf):
    o, st, tp = tb.table(spark, sf, "orders"), F.col("o_orderstatus"), F.col("o_totalprice")
    src = o.select("o_orderkey", F.when(st != "F", tp).alias("jitter"), F.when(tp > 100000, tp).alias("hnr"), F.when(st == "P", 1.0).alias("cadence"), F.when(tp > 400000, tp / 1e4).alias("age"), F.when(st == "O", "male").alias("sex"))
    return md.presence(src, {"voice": ["jitter", "hnr"], "motor": ["cadence"]}).drop("jitter", "hnr", "cadence")


@query("I11_score_batch")
def score_batch(spark, sf):
    wide, cols = _features(spark, sf)
    all_cols = [c for cs in cols.values() for c in cs]
    model = Pipeline(stages=[*md.feature_stages(all_cols), LogisticRegression(labelCol="y", maxIter=100)]).fit(wide.where("split = 'train'"))
    return md.score_batch(wide, model, MODS).select("vec_id", "n_present", "status", "risk_score")


OS = "os AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, least(o_totalprice/5e5, 1e0) AS s, (o_custkey % 1000)/1e3 AS b FROM orders)"


def _order_scores(spark, sf):
    o = tb.table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.least(F.col("o_totalprice") / 5e5, F.lit(1.0)).alias("s"), (F.col("o_custkey") % 1000 / 1e3).alias("b"))


CURVE = f"""{OS}, ct AS (SELECT s, sum(y) AS pos, sum(1-y) AS neg FROM os GROUP BY ALL),
cu AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM ct WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "I12_binary_metrics",
    f"""WITH {CURVE}, c AS (SELECT CAST(sum(y) FILTER (s >= 0.5) AS BIGINT) AS tp, CAST(sum(1-y) FILTER (s >= 0.5) AS BIGINT) AS fp, CAST(sum(1-y) FILTER (s < 0.5) AS BIGINT) AS tn, CAST(sum(y) FILTER (s < 0.5) AS BIGINT) AS fn FROM os),
a AS (SELECT CAST(sum(pos*(2*nb+neg)) AS DOUBLE)/(2*CAST(max(pp) AS DOUBLE)*CAST(max(nn) AS DOUBLE)) AS auc FROM cu)
SELECT tp, fp, tn, fn, {r4("((tp+tn)/CAST(tp+fp+tn+fn AS DOUBLE))")} AS accuracy, {r4("(tp/CAST(tp+fp AS DOUBLE))")} AS precision, {r4("(tp/CAST(tp+fn AS DOUBLE))")} AS recall,
  {r4("(2*tp/CAST(2*tp+fp+fn AS DOUBLE))")} AS f1, {r4("auc")} AS roc_auc, tp+fp+tn+fn AS n_samples, {r4("((tp+fn)/CAST(tp+fp+tn+fn AS DOUBLE))")} AS class_balance FROM c, a""",
)
def binary_metrics(spark, sf):
    return ev.binary_metrics(_order_scores(spark, sf), "y", "s")


_cdf, _acc = [], 0.0
for _k in range(9):
    _acc += math.exp(-1) / math.factorial(_k)
    _cdf.append(_acc)
_w = " + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in _cdf)


@query(
    "I13_bootstrap_auc_diff",
    f"""WITH b AS (SELECT doc_id, toxic AS y, least(n_chars/2e4, 1e0) AS a FROM documents JOIN labels USING (doc_id)),
r AS (SELECT y, a, rep, CAST(CAST('0x' || substr(md5(doc_id || ':' || rep || ':42'), 1, 8) AS BIGINT) AS DOUBLE)/4294967296e0 AS u FROM b, (SELECT unnest(range(1, 1001)) AS rep)),
w AS (SELECT y, a, rep, {_w} AS w FROM r),
c AS (SELECT rep, a AS s, sum(w*y) AS pos, sum(w*(1-y)) AS neg FROM w WHERE w > 0 GROUP BY ALL),
q AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM c),
d AS (SELECT rep, CAST(sum(pos*(2*nb+neg)) AS DOUBLE)/(2*CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE)) - 0.5::DOUBLE AS d FROM q GROUP BY rep HAVING sum(pos) > 0 AND sum(neg) > 0),
g AS (SELECT count(*) AS replicates, avg(d) AS m, quantile_cont(d, 0.025::DOUBLE) AS lo, quantile_cont(d, 0.975::DOUBLE) AS hi FROM d)
SELECT replicates, {r4("m")} AS auc_diff_mean, {r4("lo")} AS ci_lower, {r4("hi")} AS ci_upper, {r4("lo")} > 0 AS significant FROM g""",
)
def bootstrap(spark, sf):
    docs = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id")
    s = docs.select("doc_id", "toxic", F.least(F.col("n_chars") / 2e4, F.lit(1.0)).alias("a"), F.lit(0.5).alias("b"))
    return ev.bootstrap_auc_diff(s, "doc_id", "toxic", "a", "b", n=1000)


@query("I14_roc_points", f"WITH {CURVE} SELECT s AS threshold, {r4('((nn-nb)/CAST(nn AS DOUBLE))')} AS fpr, {r4('((pp-pb)/CAST(pp AS DOUBLE))')} AS tpr FROM cu")
def roc_points(spark, sf):
    return ev.roc_points(_order_scores(spark, sf), "y", "s")


@query("I15_calibration", f"WITH {OS} SELECT CAST(least(floor(s*8), 7) AS BIGINT) AS bin, count(*) AS n, {r4('avg(y)')} AS fraction_positive, {r4('avg(s)')} AS mean_predicted FROM os GROUP BY 1")
def calibration(spark, sf):
    return ev.calibration(_order_scores(spark, sf), "y", "s")


@query("I15_brier", f"WITH {OS} SELECT {r4('avg((s-y)*(s-y))')} AS brier FROM os")
def brier(spark, sf):
    return ev.brier(_order_scores(spark, sf), "y", "s")


_scen = ", ".join("(" + ", ".join([f"'{n}'"] + [str(int(m in act)) for m in MODS]) + ")" for n, act in ev.scenarios(MODS))
_num, _den = " + ".join(f"p_{m}*on_{m}*pr_{m}" for m in MODS), " + ".join(f"on_{m}*pr_{m}" for m in MODS)
_wide = ", ".join(f"max(p) FILTER (modality = '{m}') AS p_{m}, max(present) FILTER (modality = '{m}') AS pr_{m}" for m in MODS)


@query(
    "I16_missing_sweep",
    f"""WITH {SCORES}, w AS (SELECT vec_id, y, {_wide} FROM sc GROUP BY ALL), sn(scenario, {", ".join(f"on_{m}" for m in MODS)}) AS (VALUES {_scen}),
r AS (SELECT scenario, y, CASE WHEN {_den} > 0 THEN ({_num})/({_den}) ELSE 0.5::DOUBLE END AS raw FROM w, sn), q AS (SELECT scenario, y, raw AS s FROM r),
ct AS (SELECT scenario, s, sum(y) AS pos, sum(1-y) AS neg FROM q GROUP BY ALL),
cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY scenario ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM ct),
m AS (SELECT scenario, CAST(sum(pos*(2*nb+neg)) AS DOUBLE)/(2*CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE)) AS auc, coalesce(sum(pos) FILTER (s >= 0.5), 0) AS tp, coalesce(sum(neg) FILTER (s >= 0.5), 0) AS fp, coalesce(sum(pos) FILTER (s < 0.5), 0) AS fn FROM cu GROUP BY ALL),
f AS (SELECT scenario, {r4("auc")} AS roc_auc, CASE WHEN 2*tp+fp+fn > 0 THEN {r4("(2*tp/CAST(2*tp+fp+fn AS DOUBLE))")} ELSE 0e0 END AS f1 FROM m), z AS (SELECT roc_auc AS a, f1 AS b FROM f WHERE scenario = 'all')
SELECT scenario, roc_auc, f1, {r4("(a-roc_auc)")} AS auc_drop, {r4("(b-f1)")} AS f1_drop FROM f, z""",
)
def missing_sweep(spark, sf):
    wide = _scores(spark, sf).groupBy("vec_id", "y").agg(
        *[F.max(F.when(F.col("modality") == m, F.col("p"))).alias(f"p_{m}") for m in MODS], *[F.max(F.when(F.col("modality") == m, F.col("present"))).alias(f"present_{m}") for m in MODS]
    )
    return ev.missing_sweep(wide, "y", MODS)


@query("I17_gate_summary", f"WITH {GATES} SELECT modality, {r4('avg(weight)')} AS average_weight, {r4('(1-avg(present))')} AS missing_rate FROM gw GROUP BY modality")
def gate_summary(spark, sf):
    return ev.gate_summary(_gates(spark, sf))


GATED = 51  # with 8 demographic dimensions and 5 presence flags, all 64 dimensions of the table


def _shap(spark, sf):
    """The embedding dimensions stand for the attribution of a fused vector with 51 gated dimensions."""
    e = tb.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_index", "v")).select("sample_id", "feature_index", F.col("v").cast("double").alias("shap_value"))


_grp = "CASE WHEN feature_index < 51 THEN 'gated' WHEN feature_index < 59 THEN 'demographic' " + " ".join(f"WHEN feature_index = {59 + i} THEN 'presence_{m}'" for i, m in enumerate(MODS)) + " END"
SHAP = f"""sh0 AS (SELECT vec_id AS sample_id, unnest(range(64)) AS feature_index, CAST(unnest(embedding) AS DOUBLE) AS shap_value FROM embeddings), sh AS (SELECT *, {_grp} AS feature_group FROM sh0)"""


@query("I18_global_importance", f"WITH {SHAP}, g AS (SELECT feature_index, feature_group, avg(abs(shap_value)) AS m FROM sh GROUP BY ALL) SELECT feature_index, feature_group, {rn('m', 6)} AS mean_abs_shap, row_number() OVER (ORDER BY m DESC, feature_index) AS rank FROM g")
def global_importance(spark, sf):
    return ev.global_importance(_shap(spark, sf), GATED)


@query(
    "I19_modality_importance",
    f"""WITH {SHAP}, {GATES}, p AS (SELECT feature_index, feature_group, avg(abs(shap_value)) AS m FROM sh GROUP BY ALL), g AS (SELECT feature_group, sum(m) AS m FROM p GROUP BY ALL),
aw AS (SELECT modality, avg(weight) AS w FROM gw GROUP BY ALL), t AS (SELECT modality, g.m + (SELECT m FROM g WHERE feature_group = 'gated')*w/(SELECT sum(w) FROM aw) AS total FROM aw JOIN g ON g.feature_group = 'presence_' || modality
UNION ALL SELECT 'demographic_covariates', m FROM g WHERE feature_group = 'demographic')
SELECT modality, {rn("total", 6)} AS mean_abs_shap, {rn("(1e2*total/(SELECT sum(total) FROM t))", 2)} AS percent FROM t""",
)
def modality_importance(spark, sf):
    return ev.modality_importance(_shap(spark, sf), _gates(spark, sf), GATED)


@query("I20_local_contributors", f"WITH {SHAP}, r AS (SELECT *, CASE WHEN shap_value > 0 THEN 'positive' ELSE 'negative' END AS direction FROM sh WHERE shap_value <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, direction ORDER BY abs(shap_value) DESC, feature_index) AS rank FROM r) SELECT sample_id, direction, rank, feature_index, {rn('shap_value', 6)} AS shap_value FROM k WHERE rank <= 5")
def local_contributors(spark, sf):
    return ev.local_contributors(_shap(spark, sf))


@query("I20_net_direction", f"WITH {SHAP}, g AS (SELECT sample_id, feature_group, sum(shap_value) AS net FROM sh GROUP BY ALL) SELECT sample_id, feature_group, CASE WHEN net > 1e-6 THEN 'positive' WHEN net < -1e-6 THEN 'negative' ELSE 'mixed' END AS direction FROM g")
def net_direction(spark, sf):
    return ev.net_direction(_shap(spark, sf), gated=GATED)


@query("I21_stability", "SELECT o_custkey, count(*) AS runs, max(o_totalprice) - min(o_totalprice) AS spread, max(o_totalprice) - min(o_totalprice) <= 1e-5 AS stable FROM orders GROUP BY o_custkey")
def stability(spark, sf):
    return ev.stability(tb.table(spark, sf, "orders"), "o_custkey", "o_totalprice")
