"""Chained regressions against a direct loop."""

import numpy as np

from panelspark.operators.clean import fill_chained


def test_chained_fill_settles_at_the_direct_fixed_point(spark):
    rng = np.random.default_rng(2)
    n = 200
    f = rng.normal(size=n)
    a = f + 2 * rng.normal(size=n)
    b = 20 * a - 10 * f + 50 * rng.normal(size=n) + 1000
    e = 0.2 * a + f + 2 * rng.normal(size=n)
    x = np.column_stack([a, b, e])
    hole = rng.random((n, 3)) < 0.25
    rows = [(i, *[None if hole[i, j] else float(x[i, j]) for j in range(3)], float(f[i]), None) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, e double, f double, none double").repartition(3)
    out, rounds, settled = fill_chained(df, ["a", "b", "e", "none"], ["f"], tol=1e-6)
    assert settled and 1 < rounds < 50
    got = {r.id: r for r in out.collect()}
    assert len(got) == n and all(r.none is None for r in got.values())
    cur = np.where(hole, np.nan, x)
    cur = np.where(hole, np.nanmean(cur, axis=0), cur)
    for _ in range(200):
        for j in range(3):
            m = np.column_stack([np.ones(n), cur[:, [k for k in range(3) if k != j]], f])
            beta = np.linalg.lstsq(m[~hole[:, j]], cur[~hole[:, j], j], rcond=None)[0]
            cur[hole[:, j], j] = m[hole[:, j]] @ beta
    assert np.allclose([[got[i].a, got[i].b, got[i].e] for i in range(n)], cur, rtol=1e-3, atol=1e-3)
    assert all(getattr(got[i], k) == float(x[i, j]) for i in range(n) for j, k in enumerate("abe") if not hole[i, j])
    none, rounds, settled = fill_chained(df.limit(0), ["a"], ["f"])
    assert none.count() == 0 and settled and rounds == 0
