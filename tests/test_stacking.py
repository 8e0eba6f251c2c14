"""Combined extinction risk: held-out quality, folds and percentile features."""

import numpy as np
import pytest

from panelspark.operators import stacking as S


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(12)
    n = 500
    x = rng.normal(size=(n, 3))
    risk = 1.2 * x[:, 0] + (x[:, 1] > 0.5) * (x[:, 2] > 0) * 2.0 - 0.8
    y = (rng.random(n) < 1 / (1 + np.exp(-risk))).astype(int)
    t = np.where(y == 1, rng.integers(1, 40, n), 40)
    rows = [(i, "ab"[i % 2], int(y[i]), float(t[i]), int(y[i]), *(None if rng.random() < 0.03 else float(v) for v in x[i])) for i in range(n)] + [(n, "a", None, 3.0, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, market string, gone int, duration double, event int, a double, b double, c double").repartition(3)
    wide, names = S.percentile_features(df, "id", "market", ["a", "b"])
    return df, wide, S.stacked_risk(wide, "gone", ["a", "b", "c", *names], "id", folds=3, trees=20, rounds=10).persist()


def test_percentiles(scored):
    df, wide, _ = scored
    rows = df.collect()
    for r in wide.collect()[:60]:
        own = [q.a for q in rows if q.market == r.market and q.a is not None]
        want = None if r.a is None else (sum(v < r.a for v in own) + sum(v <= r.a for v in own) + 1) / (2 * len(own))
        assert (r.a_pct is None) == (want is None) and (want is None or abs(r.a_pct - want) < 1e-12 and r.a_low == float(want < 0.25))


def test_every_row_gets_a_risk_it_was_not_fitted_on(scored):
    _, wide, out = scored
    rows = out.collect()
    assert len(rows) == 500 and len({r.id for r in rows}) == 500
    assert all(0 <= r[m] <= 1 for r in rows for m in (*S.MEMBERS, "average", "stacked"))
    assert all(abs(r.average - np.mean([r[m] for m in S.MEMBERS])) < 1e-12 for r in rows)
    assert 100 < sum(r.held_out for r in rows) < 240


def test_quality_on_held_out_rows(scored):
    _, _, out = scored
    rows = [r for r in out.collect() if r.held_out]
    q = {r.member: r for r in S.member_quality(out, "gone").collect()}
    assert set(q) == {*S.MEMBERS, "average", "stacked"}
    for m, r in q.items():
        pos, neg = ([x[m] for x in rows if x.gone == k] for k in (1, 0))
        assert abs(r.auc - np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) < 1e-9 and abs(r.brier - np.mean([(x[m] - x.gone) ** 2 for x in rows])) < 1e-9
        assert r.auc > 0.65 and r.c_index > 0.6
    assert q["stacked"].auc > max(q[m].auc for m in S.MEMBERS) - 0.04
    g = {r.market: r for r in S.risk_by_group(out, "market").collect()}
    own = [r.stacked for r in out.collect() if r.market == "a"]
    assert g["a"].n == len(own) and abs(g["a"].mean_risk - np.mean(own)) < 1e-9 and abs(g["a"].median_risk - np.median(own)) < 1e-9


def test_folds(spark):
    with pytest.raises(ValueError):
        S.stacked_risk(spark.createDataFrame([(1, 1, 2.0, 1, 0.0)], "id int, gone int, duration double, event int, x double"), "gone", ["x"], "id", folds=2)


def test_fits_run_together(spark):
    import threading

    # each job waits for the others, so jobs one after another would not end
    gate = threading.Barrier(3)

    def job(k):
        gate.wait(60)
        return spark.range(k).count()

    assert S._together(spark, [lambda k=k: job(k) for k in (3, 1, 2)]) == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        S._together(spark, [lambda: 1 / 0])
