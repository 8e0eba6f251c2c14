"""Robust errors of the hazards model against direct sums."""

import numpy as np

from panelspark.operators import robust
from panelspark.operators.survival import cox


def direct(t, e, x, beta):
    """Breslow score residuals, by loops."""
    w = np.exp(x @ beta)
    mean = lambda s: (w[t >= s][:, None] * x[t >= s]).sum(0) / w[t >= s].sum()
    out = np.zeros_like(x)
    for i in range(len(t)):
        out[i] = e[i] * (x[i] - mean(t[i]))
        for s in np.unique(t[(e == 1) & (t <= t[i])]):
            out[i] -= ((t == s) & (e == 1)).sum() / w[t >= s].sum() * w[i] * (x[i] - mean(s))
    return out


def test_sandwich_equals_direct_sum(spark):
    rng = np.random.default_rng(4)
    n = 60
    x = rng.normal(size=(n, 2))
    t, e, g = np.round(rng.exponential(4, n), 0) + rng.choice([0, 0.25], n), (rng.random(n) < 0.7).astype(int), rng.integers(0, 9, n)
    df = spark.createDataFrame([(i, float(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1]), int(g[i])) for i in range(n)] + [(99, None, 1, 1.0, 1.0, 1), (98, 2.0, 1, None, 1.0, 1)],
                               "id int, duration double, event int, a double, b double, g int").repartition(3)
    fit = cox(df.dropna(), ["a", "b"], ties="breslow")
    r = direct(t, e, x, fit.coef)
    got = {row.id: (row.r_a, row.r_b) for row in robust.score_residuals(df, ["a", "b"], [float(v) for v in fit.coef], ["id"]).collect()}
    assert set(got) == set(range(n)) and np.allclose([got[i] for i in range(n)], r, atol=1e-9)
    assert np.allclose(r.sum(0), 0, atol=1e-4)
    for cluster in (None, "g"):
        sums = r if cluster is None else np.array([r[g == k].sum(0) for k in range(9)])
        want = np.sqrt(np.diag(fit.cov @ sums.T @ sums @ fit.cov))
        rows = robust.robust_cox(df, ["a", "b"], cluster).collect()
        assert np.allclose([q.robust_se for q in rows], want, rtol=1e-6) and np.allclose([q.coef for q in rows], fit.coef, rtol=1e-6)
    z = direct(t, e, x, np.zeros(2))
    assert abs(robust.robust_score_test(df, ["a", "b"])["chi2"] - z.sum(0) @ np.linalg.inv(z.T @ z) @ z.sum(0)) < 1e-8
