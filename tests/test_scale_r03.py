"""Large-table rules: inputs of repeated passes are written once, and Python works on whole batches."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from panelspark.operators import clean, cluster, emergence, lifecycle, market, regression, resampling, robust, survival


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_growth_curves_fit_whole_batches(spark):
    rng = np.random.default_rng(7)
    series = {i: rng.normal(size=int(n)).cumsum() for i, n in enumerate(rng.integers(1, 12, 60))}
    series[60], series[61] = np.full(5, 3.0), np.exp(np.arange(8.0))
    rows = [(i, 1990 + j, float(x)) for i, v in series.items() for j, x in enumerate(v)]
    rng.shuffle(rows)
    out = emergence.growth_curves(spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in rows], "company_id long, year int, v double"), "v")
    # no Python call per entity
    assert "FlatMapGroupsInPandas" not in plan(out)
    got = {r["company_id"]: r for r in out.collect()}
    assert set(got) == set(series)
    for i, v in series.items():
        r = got[i]
        assert (r["n"], r["lo"], r["hi"]) == (len(v), v.min(), v.max())
        if len(v) < 3 or v.min() == v.max():
            assert r["curve"] == "none"
            continue
        x, s = np.arange(len(v)) / (len(v) - 1), (v - v.min()) / (v.max() - v.min())

        def fit(f):
            m = np.column_stack([np.ones_like(f), f])
            k = np.linalg.lstsq(m, s, rcond=None)[0]
            return 1 - ((s - m @ k) ** 2).sum() / ((s - s.mean()) ** 2).sum(), *k

        best = {"linear": fit(x), "logarithmic": fit(np.log1p(x)),
                "exponential": max(fit(np.exp(q * x)) for q in np.linspace(0.25, 8, 32)), "decline": max(fit(np.exp(-q * x)) for q in np.linspace(0.25, 8, 32)),
                "s_curve": max(fit(1 / (1 + np.exp(-q * (x - m)))) for q in np.linspace(2, 20, 10) for m in np.linspace(0.1, 0.9, 9))}
        lead = {k: b[0] - (k != "linear") * 0.02 for k, b in best.items()}
        # families that fit equally well may stand for each other
        assert lead[r["curve"]] == pytest.approx(max(lead.values()), abs=1e-9)
        assert r["r2"] == pytest.approx(best[r["curve"]][0], abs=1e-9)


def counted(df):
    """``df`` behind a step that counts the rows it hands out, and the count."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def step(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(step, df.schema), seen


def people(spark, n=90):
    rng = np.random.default_rng(3)
    rows = [(i, 1994 + i % 6, "AB"[i % 2], *map(float, rng.normal(size=3)), float(rng.random() < 0.5), int(rng.integers(1, 900)), int(rng.random() < 0.6)) for i in range(n)]
    return spark.createDataFrame(rows, "company_id long, year int, market string, a double, b double, y double, label double, duration int, event int")


READERS = {
    "features": lambda d: cluster.features(d, ["a", "b"]).collect(),
    "mixture": lambda d: cluster.fit_clusters(cluster.features(d, ["a", "b"], "robust"), "mixture", 2).collect(),
    "hierarchy": lambda d: cluster.cluster_stats(cluster.fit_clusters(cluster.features(d, ["a", "b"]), "hierarchy", 2), ["a", "b"]).collect(),
    "pca": lambda d: cluster.pca(d, ["a", "b"], 2)[0].collect(),
    "choose_k": lambda d: cluster.choose_k(d, ["a", "b"], (2, 3))[0].collect(),
    "ensemble": lambda d: cluster.ensemble(d, "y", ["a", "b"], "year", 1998).collect(),
    "strategic_groups": lambda d: market.group_competition(market.strategic_groups(d.withColumns({"roe": F.col("y"), "margin": F.col("y"), "growth": F.col("y"), "share": F.col("y")}), ["a", "b"], 2), ["a", "b"]).collect(),
    "success_model": lambda d: emergence.success_model(d, "label", ["a", "b"], "year", 1998)[0].collect(),
    "choose_alpha": lambda d: regression.choose_alpha(d, "y", ["a", "b"], [0.1, 1.0]).collect(),
    "fill_model": lambda d: clean.fill_model(d.withColumn("y", F.when(F.col("a") < 1, F.col("y"))), ["y"], ["a", "b"], trees=2).collect(),
    "hazard_model": lambda d: survival.hazard_model(d.withColumns({"time_from_start": F.lit(0), "event_occurred": F.col("event")}), ["a", "b"], "forest", 2, 2)[0].collect(),
    "propensity": lambda d: survival.propensity(d, "label", ["a", "b"]).collect(),
    "correction_effectiveness": lambda d: survival.correction_effectiveness(d, "a", "b", "label").collect(),
    "interval_of_fit": lambda d: resampling.interval_of_fit(d, ["a", "b"], "company_id", 10).collect(),
    "rejuvenation_factors": lambda d: lifecycle.rejuvenation_factors(d.withColumn("company_id", F.expr("company_id div 3")), d.sparkSession.createDataFrame(
        [(i, 1990, 2000, i % 3 == 0) for i in range(30)], "company_id long, peak_year int, trough_year int, recovered boolean"), ["a", "b"]).collect(),
}


@pytest.mark.parametrize("name", READERS)
def test_repeated_passes_read_the_input_once(spark, name):
    d = people(spark)
    source, seen = counted(d)
    assert READERS[name](source)
    assert seen.value == d.count()


def test_the_share_pass_leaves_the_same_rows(spark):
    from panelspark.sources import derive

    sf = "/root/testdata/sf0.001"
    cols = ["company_id", "year", "market", "growth", "margin", "stage", "debt"]
    a, b = (derive.staged(spark, sf, share=x).select(cols) for x in (True, False))
    assert a.count() and not a.exceptAll(b).count() and not b.exceptAll(a).count()
    assert plan(b).count("lineitem.parquet") < plan(a).count("lineitem.parquet")


def test_robust_cox_takes_a_fit(spark):
    d = people(spark)
    fit = survival.cox(d, ["a", "b"], ties="breslow")
    one, two = (robust.robust_cox(d, ["a", "b"], "market", f).collect() for f in (None, fit))
    assert [tuple(r) for r in one] == [pytest.approx(tuple(r)) for r in two]


def test_poisson_weights_are_the_inverse_distribution():
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 3000)
    z = keys.astype(np.uint64)[:, None] + np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    w = resampling.poisson_weights(keys, 200)
    assert (w[:, 0] == 1).all() and (w[:, 1:] == np.searchsorted(resampling._CDF, u, side="right")).all()


def test_factor_facts_take_each_wide_row_once(spark):
    from panelspark.operators import factors

    rows = [(1, 2000, 1.5, None, -2.0), (1, 2001, None, None, None), (2, 2000, 0.0, float("nan"), 7.0), (None, None, 3.0, 4.0, 5.0)]
    wide = spark.createDataFrame(rows, "company_id long, year int, a_01 double, a_02 double, b_01 double")
    long = factors.factor_facts(wide)
    assert long.columns == ["company_id", "year", "factor", "value"]
    # nulls and rows without a key stay, one row per column
    want = [(r[0], r[1], n, r[i]) for r in rows for i, n in enumerate(wide.columns[2:], 2)]
    assert sorted(map(repr, map(tuple, long.collect()))) == sorted(map(repr, want))
    # no Expand, which copies the wide row once per column
    assert "Expand" not in plan(long)


def test_factor_measures_sort_rows_once(spark):
    from panelspark.operators import factors
    from panelspark.plans.factors import panel

    p = panel(spark, "/root/testdata/sf0.001").limit(50)
    d = spark.createDataFrame(p.collect(), p.schema)
    # one order serves all windows
    assert factors.factors(d)._jdf.queryExecution().executedPlan().toString().count("Sort [company_id") == 1
