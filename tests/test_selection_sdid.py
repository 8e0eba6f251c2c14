"""Stepwise paths against refits; synthetic and group-time effects against direct computation."""

import numpy as np
import pytest

from panelspark.operators import selection as S
from panelspark.operators import synthetic_did as D


def rss(x, y, cols):
    m = np.column_stack([np.ones(len(y)), *[x[:, j] for j in cols]])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    return float(((y - m @ b) ** 2).sum()), b


def test_sweeps_undo_each_other():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 5))
    a = m.T @ m
    b = S.sweep(S.sweep(a, 1), 3)
    assert np.allclose(S.unsweep(S.unsweep(b, 1), 3), a) and np.allclose(b[np.ix_([1, 3], [1, 3])], -np.linalg.inv(a[np.ix_([1, 3], [1, 3])]))


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
@pytest.mark.parametrize("kind", ["bic", "aic"])
def test_path_equals_refits(spark, direction, kind):
    rng = np.random.default_rng(5)
    n = 120
    x = rng.normal(size=(n, 5)) * [1, 100, 1, 0.01, 1] + [0, 1e4, 0, 0, 3]
    x[:, 2] = x[:, 0] + 0.6 * x[:, 4] + 0.3 * rng.normal(size=n)
    x = np.column_stack([x, x[:, 0] - x[:, 4]])  # explained by others
    y = 2 * x[:, 0] - 0.03 * x[:, 1] + 1.5 * x[:, 4] + rng.normal(size=n) * 2
    names = [f"x{i}" for i in range(6)]
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in [*names, "y"]))
    g = S.gram(df, "y", names)
    path, inside, a = S.stepwise(g, kind, direction)
    now, cols = None, [0, 1, 2, 3, 4] if direction == "backward" else []
    score = lambda k: S.criterion(n, rss(x, y, k)[0], len(k), kind)
    for step, action, term, r, value in path:
        if action != "start":
            options = [score([*cols, j]) for j in range(6) if j not in cols and direction != "backward" and not ({0, 4, 5} <= {*cols, j})]
            options += [score([i for i in cols if i != j]) for j in cols if direction != "forward"]
            j = int(term[1:])
            cols = [*cols, j] if action == "in" else [i for i in cols if i != j]
            assert value < now and abs(value - min(options)) < 1e-6
        now = value
        assert abs(r - rss(x, y, cols)[0]) < 1e-6 * r and abs(value - score(cols)) < 1e-6
    assert sorted(cols) == inside
    # no single move from the end is better
    ends = [score([*cols, j]) for j in range(6) if j not in cols and direction != "backward" and not {0, 4, 5} <= {*cols, j}]
    ends += [score([i for i in cols if i != j]) for j in cols if direction != "forward"]
    assert all(now <= v + 1e-6 for v in ends)
    t = {q.term: q for q in S.model_table(spark, g, inside, a).collect()}
    b = rss(x, y, inside)[1]
    m = np.column_stack([np.ones(n), x[:, inside]])
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss(x, y, inside)[0] / (n - len(inside) - 1))
    assert np.allclose([t["intercept"].coef, *[t[names[j]].coef for j in inside]], b, rtol=1e-5) and np.allclose([t[names[j]].se for j in inside], se[1:], rtol=1e-5)


def test_no_rows_to_select_from(spark):
    with pytest.raises(ValueError):
        S.gram(spark.createDataFrame([], "x double, y double"), "y", ["x"])


def test_weights_are_optimal():
    rng = np.random.default_rng(3)
    x, target = rng.normal(size=(9, 6)), rng.normal(size=9)
    w = D.simplex_fit(x, target, 0.3)
    xc, tc = x - x.mean(0), target - target.mean()
    grad = xc.T @ (xc @ w - tc) + 0.3 * w
    # no weight can move to a cheaper unit: gradients of used units are equal and least
    assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and np.ptp(grad[w > 1e-9]) < 1e-8 and grad.min() > grad[w > 1e-9].max() - 1e-8
    value = lambda v: ((xc @ v - tc) ** 2).sum() + 0.3 * (v @ v)
    assert all(value(w) <= value(v) for v in rng.dirichlet(np.ones(6), 2000))


def panel(effect):
    rng = np.random.default_rng(8)
    level, load, f, g = rng.normal(5, 2, 20), rng.normal(1, 0.5, 20), np.cumsum(rng.normal(size=12)), np.linspace(0, 3, 12)
    y = level[:, None] + np.outer(load, f) + g + rng.normal(size=(20, 12)) * 0.1
    y[:2, 8:] += effect
    return y


def test_known_effect_is_found(spark):
    y = panel(3.0)
    rows = [(f"u{i:02d}", t, float(y[i, t]) + d) for i in range(20) for t in range(12) for d in (-0.5, 0.5)] + [("u20", 1, 2.0), (None, 1, 2.0), ("u03", 1, None)]
    df = spark.createDataFrame(rows, "unit string, period int, y double").repartition(4)
    r = D.synthetic_did(df, "y", "unit", "period", ["u00", "u01"], 8)
    assert abs(r["effect"] - 3) < 0.3 and r["se"] < 0.5 and r["p"] < 1e-6 and r["left_out"] == ["u20"]
    assert abs(sum(r["unit_weights"].values()) - 1) < 1e-9 and set(r["period_weights"]) == set(range(8))
    assert abs(D.estimate(y, np.arange(20) < 2, 8)[0] - r["effect"]) < 1e-9
    none = D.synthetic_did(df.where("unit not in ('u00', 'u01')"), "y", "unit", "period", ["u05"], 8)
    assert abs(none["effect"]) < 4 * none["se"] + 0.2
    # the weighted estimate of the definition
    co = y[2:]
    om, la = np.array(list(r["unit_weights"].values())), np.array(list(r["period_weights"].values()))
    want = (y[:2, 8:].mean() - (y[:2, :8].mean(0) @ la)) - om @ (co[:, 8:].mean(1) - co[:, :8] @ la)
    assert abs(want - r["effect"]) < 1e-9


def test_inputs_that_have_no_answer(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 1.0), ("b", 2, 2.0)], "unit string, period int, y double")
    for start in (1, 2, 9):
        with pytest.raises(ValueError):
            D.synthetic_did(df, "y", "unit", "period", ["a"], start)
    with pytest.raises(ValueError):
        D.synthetic_did(df, "y", "unit", "period", ["a"], 2, most_units=1)


def test_group_time_effects(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        g = [None, 2003, 2005, 2004][i % 4]
        for t in range(2000, 2008):
            if rng.random() < 0.9:
                rows.append((i, t, g, float(i % 5 + 0.3 * t + rng.normal() * 0.1 + (2.0 + (t - g) if g and t >= g else 0))))
    df = spark.createDataFrame(rows, "id int, year int, treat_year int, y double").repartition(3)
    got = {(r.cohort, r.year): r for r in D.group_time_effects(df, "y").collect()}

    def mean(t, ok):
        return np.mean([v for _, u, g, v in rows if u == t and ok(g)])

    for g in (2003, 2004, 2005):
        for t in range(2000, 2008):
            free = lambda h: h is None or (h > max(t, g - 1) and h != g)  # noqa: B023,E731
            want = mean(t, lambda h: h == g) - mean(g - 1, lambda h: h == g) - mean(t, free) + mean(g - 1, free)
            assert abs(got[g, t].effect - want) < 1e-9 and got[g, t].since == t - g
    assert abs(got[2003, 2006].effect - 5) < 1.0
    e = D.group_time_effects(df, "y")
    ex = {r.since: r.effect for r in D.by_exposure(e).collect()}
    want = [(got[g, g + 1].effect, got[g, g + 1].n_treated) for g in (2003, 2004, 2005)]
    assert abs(ex[1] - sum(a * n for a, n in want) / sum(n for _, n in want)) < 1e-9
    co = D.by_cohort(e).collect()
    assert len(co) == 3 and abs(co[0].overall - sum(r.effect * r.n for r in co) / sum(r.n for r in co)) < 1e-9
    assert D.group_time_effects(df.limit(0), "y").count() == 0
