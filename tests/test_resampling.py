"""Weighted and bootstrapped concordance against pairs."""

import numpy as np
import pytest

from panelspark.operators import resampling as R
from panelspark.operators.survival import concordance


def pairs(t, e, s, w):
    con = dis = comp = 0.0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] == 1 and t[i] < t[j]:
                comp = comp + w[i] * w[j]
                con = con + w[i] * w[j] * (s[i] > s[j])
                dis = dis + w[i] * w[j] * (s[i] < s[j])
    return con, dis, comp


def subjects(spark, n, seed, spread):
    rng = np.random.default_rng(seed)
    t, e, s = rng.integers(1, spread, n).astype(float), (rng.random(n) < 0.6).astype(int), rng.integers(0, spread, n).astype(float)
    rows = [(i, float(t[i]), int(e[i]), float(s[i])) for i in range(n)]
    return t, e, s, spark.createDataFrame(rows + [(1000, None, 1, 1.0), (1001, 3.0, 0, None)], "id long, duration double, event int, score double").repartition(3)


@pytest.mark.parametrize("n, spread, rows", [(70, 8, 16), (40, 100, 2048), (60, 2, 7), (1, 5, 4)])
def test_replicates_equal_pairs(spark, n, spread, rows):
    t, e, s, df = subjects(spark, n, n, spread)
    from pyspark.sql import functions as F
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    w = R.poisson_weights(np.array([keys[i] for i in range(n)]), 5)
    got = {r.b: r for r in R.weighted_concordance(df, "score", "id", lambda k: R.poisson_weights(k, 5), rows).collect()}
    assert len(got) == 6
    for b in range(6):
        assert (got[b].concordant, got[b].discordant, got[b].comparable) == pairs(t, e, s, w[:, b])
    assert got[0].c_index == concordance(df, "score").first().c_index


def test_poisson_weights():
    w = R.poisson_weights(np.arange(4000), 50)[:, 1:]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_interval_and_folds(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(size=n)
    t = rng.exponential(np.exp(-0.7 * x)) * 10
    df = spark.createDataFrame([(i, float(t[i]), 1, float(x[i])) for i in range(n)], "id long, duration double, event int, x double")
    r = R.interval_of_fit(df, ["x"], "id", 200).first()
    direct = []
    for _ in range(100):
        k = rng.integers(0, n, n)
        m = (t[k][:, None] < t[k]) & True
        direct.append((m & (x[k][:, None] > x[k])).sum() / m.sum())
    assert r.lower < r.c_index < r.upper and r.draws == 200 and abs(r.se - np.std(direct)) < 0.4 * np.std(direct)
    f = R.cross_validated_concordance(df, ["x"], "id").collect()
    assert len(f) == 5 and abs(f[0].mean_c - np.mean([q.c_index for q in f])) < 1e-12 and abs(f[0].mean_c - r.c_index) < 0.03
