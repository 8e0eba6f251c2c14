"""Parametric survival fits against direct likelihoods."""

import math

import numpy as np
import pytest

from panelspark.functions import finish
from panelspark.operators import parametric as P


def test_incomplete_gamma_and_its_derivatives():
    for a in (0.05, 0.3, 0.5, 1.0, 2.7, 9.0, 40.0):
        u = np.array([1e-6, 0.01, 0.3, 0.9 * (a + 1), a + 1.0001, 2 * a + 3, 6 * a + 20])
        q, q1, q2 = P.log_upper_gamma(a, np.log(u))
        want = [math.log(max(1 - finish.gamma_inc(a, x), 1e-290)) for x in u]
        assert np.allclose(q[:5], want[:5], rtol=1e-7, atol=1e-10)
        h = 1e-4 * a
        up, down = (P.log_upper_gamma(a + s * h, np.log(u)) for s in (1, -1))
        assert np.allclose(q1, (up[0] - down[0]) / (2 * h), rtol=1e-5, atol=1e-6)
        assert np.allclose(q2, (up[1] - down[1]) / (2 * h), rtol=1e-4, atol=1e-4)
        assert abs(P.digamma(a) - (math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h)) < 1e-5 * max(1, 1 / a**2)
    z = np.array([-6.0, -1.0, 0.0, 0.5, 3.0, 12.0])
    assert np.allclose(P.log_normal_tail(z), [math.log(0.5 * math.erfc(x / math.sqrt(2))) for x in z], rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("dist", P.FAMILIES)
def test_derivatives_of_the_likelihood(dist):
    rng = np.random.default_rng(1)
    y, ev, eta, s, h = rng.normal(1, 1, 40), (rng.random(40) < 0.6).astype(float), rng.normal(0.5, 0.4, 40), 0.3, 1e-5
    f = lambda e, k: P.contributions(dist, y, ev, e, k)
    _, e1, s1, e2, es, s2 = f(eta, s)
    num = lambda i, de, ds: (f(eta + de, s + ds)[i] - f(eta - de, s - ds)[i]) / (2 * h)
    assert np.allclose(e1, num(0, h, 0), atol=1e-6) and np.allclose(e2, num(1, h, 0), atol=1e-5)
    if dist != "exponential":
        assert np.allclose(s1, num(0, 0, h), atol=1e-6) and np.allclose(s2, num(2, 0, h), atol=1e-5) and np.allclose(es, num(1, 0, h), atol=1e-5)


def sample(spark, n=3000, shape=4.0):
    rng = np.random.default_rng(7)
    x = rng.normal(size=n)
    t = np.exp(1 + 0.5 * x) * rng.gamma(shape, size=n)
    end = rng.exponential(40, n)
    return spark.createDataFrame([(float(min(a, b)), int(a <= b), float(v)) for a, b, v in zip(t, end, x)], "duration double, event int, x double")


def test_gamma_beats_weibull_on_gamma_data(spark):
    df = sample(spark)
    fits = P.fit_all(df, list(P.FAMILIES), ["x"])
    assert all(f.converged for f in fits) and P.best(fits).dist == "gamma"
    g = {f.dist: f for f in fits}
    assert abs(g["gamma"].scale - 4) < 0.5 and abs(g["gamma"].coef[0] - 0.5) < 0.05 and g["gamma"].loglik > g["weibull"].loglik > g["exponential"].loglik
    rows = P.comparison(spark, fits).collect()
    assert [r.aic_rank for r in rows] == [1, 2, 3, 4, 5] and rows[0].dist == "gamma"
    # standard errors cover the truth, and no nearby point is better
    se = {(r.dist, r.term): r.se for r in P.coefficients(spark, fits).collect()}
    assert abs(g["gamma"].coef[0] - 0.5) < 4 * se["gamma", "x"] < 0.1
    y = np.array([(math.log(r.duration), r.event, r.x) for r in df.collect()])
    for f in fits:
        at = lambda d: P.contributions(f.dist, y[:, 0], y[:, 1], f.intercept + d[0] + (f.coef[0] + d[1]) * y[:, 2], f.shape + d[2])[0].sum() - (y[:, 0] * y[:, 1]).sum()  # noqa: B023,E731
        assert abs(at((0, 0, 0)) - f.loglik) < 1e-6
        assert all(at(tuple(0.02 * v for v in d)) < f.loglik for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)))


def test_curves_and_medians(spark):
    df = sample(spark)
    for f in P.fit_all(df, list(P.FAMILIES), ["x"]):
        one = P.with_median(spark.createDataFrame([(1, 0.3), (2, None)], "id int, x double"), f)
        m = {r.id: r.median for r in one.collect()}
        assert m[2] is None
        got = {(r.id, r.t): (r.survival, r.hazard) for r in P.curves(one, f, [m[1], m[1] * 1.0001, 50.0], ["id"]).collect()}
        a, b = got[1, m[1]], got[1, m[1] * 1.0001]
        assert abs(a[0] - 0.5) < 1e-9 and abs(-(math.log(b[0]) - math.log(a[0])) / (m[1] * 1e-4) - a[1]) < 1e-3 * a[1]
        assert got[2, 50.0] == (None, None)


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError):
        P.fit_all(spark.createDataFrame([(3.0, 0), (None, 1), (0.0, 1)], "duration double, event int"), ["weibull"])
