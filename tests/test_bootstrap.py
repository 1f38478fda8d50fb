import hashlib
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from driftwell.operators import evaluation as ev
from driftwell.operators import signals as sg


def _auc(scores, labels, weights):
    pos = [(s, w) for s, y, w in zip(scores, labels, weights, strict=True) if y == 1]
    neg = [(s, w) for s, y, w in zip(scores, labels, weights, strict=True) if y == 0]
    wins = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in pos for t, b in neg)
    return wins / (sum(w for _, w in pos) * sum(w for _, w in neg))


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_bootstrap_equals_all_pairs(spark, ranges):
    rng, n = np.random.default_rng(8), 20
    # A third of the rows share one score, some labels and scores are absent, some rows repeat.
    rows = [(i // 2, [0, 1, 1, None][i % 4], 0.5 if i % 3 == 0 else float(rng.random()), None if i % 10 == 0 else float(rng.integers(0, 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = ev.bootstrap_auc_diff(df, "id", "y", "a", "b", n=n, seed=3).first()
        empty = ev.bootstrap_auc_diff(df.limit(0), "id", "y", "a", "b", n=n).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    cdf, diffs = ev.poisson_cdf(), []
    for rep in range(1, n + 1):
        u = [int(hashlib.md5(f"{r[0]}:{rep}:3".encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
        w = [int(np.sum(x >= cdf)) for x in u]
        labels = [r[1] for r in rows]
        diffs.append(_auc([r[2] for r in rows], labels, w) - _auc([-np.inf if r[3] is None else r[3] for r in rows], labels, w))
    assert got["replicates"] == n and empty["replicates"] == 0
    assert got["auc_diff_mean"] == pytest.approx(np.mean(diffs), abs=6e-5)
    assert got["ci_lower"] == pytest.approx(np.percentile(diffs, 2.5), abs=6e-5)
    assert got["ci_upper"] == pytest.approx(np.percentile(diffs, 97.5), abs=6e-5)


@pytest.mark.parametrize("helper", [ev._tally, sg._hops])
def test_helpers_need_no_package_on_the_workers(helper, tmp_path):
    (tmp_path / "helper.bin").write_bytes(cloudpickle.dumps(helper))
    code = "import pickle, sys; f = pickle.load(open('helper.bin', 'rb')); assert callable(f) and 'driftwell' not in sys.modules"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=False).returncode == 0
