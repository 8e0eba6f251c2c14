"""Small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import finish, windows as w
from panelspark.functions.cols import clip, safe_corr, sd
from panelspark.functions.ranks import exact_quantiles, ks_distance, running_min, running_totals, value_ranks
from panelspark.operators import align, causal, clean, emergence, factors, graph, lifecycle, market, outliers, quality, regression, stats, survival, timeseries


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


def test_growth_needs_the_year_before(frame):
    d = frame("company_id long, year int, x double", [(1, 2000, 100.0), (1, 2002, 150.0), (1, 2003, 300.0)])
    got = {r["year"]: r["p"] for r in d.select("year", w.year_lag("x").alias("p")).collect()}
    assert got == {2000: None, 2002: None, 2003: 150.0}


def test_zero_denominator_is_null(frame):
    d = frame("a double, b double", [(1.0, 0.0), (1.0, 4.0)])
    assert [r[0] for r in d.select(sd("a", "b")).collect()] == [None, 0.25]
    assert d.select(clip(F.lit(None).cast("double"), 0, 1)).first()[0] is None


def test_correlation_of_a_constant_is_null(frame):
    d = frame("x double, y double", [(1.0, 2.0), (1.0, 3.0)])
    assert d.agg(safe_corr("x", "y")).first()[0] is None


def test_kaplan_meier_with_ties(frame):
    d = frame("duration int, event int", list(zip([1, 2, 2, 3, 4], [1, 1, 0, 1, 0])))
    km = {r["duration"]: (round(r["s"], 9), r["n"]) for r in survival.kaplan_meier(d).collect()}
    assert km == {1: (0.8, 5), 2: (0.6, 4), 3: (0.3, 2), 4: (0.3, 1)}


def test_kaplan_meier_reaches_zero(frame):
    d = frame("duration int, event int", [(1, 1), (2, 1)])
    assert [r["s"] for r in survival.kaplan_meier(d).orderBy("duration").collect()] == [0.5, 0.0]


def test_logrank_of_equal_groups(frame):
    t = list(zip([1, 2, 2, 3, 4], [1, 1, 0, 1, 0]))
    d = frame("duration int, event int, g int", [(*x, g) for x in t for g in (0, 1)])
    r = survival.logrank(d, "g")
    assert abs(r["chi2"]) < 1e-12 and abs(r["p"] - 1) < 1e-9


def test_cox_score_is_zero_and_matches_brute_force(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=120)
    t = np.ceil(rng.exponential(np.exp(-0.7 * x)) * 20).astype(int)
    e = (rng.random(120) < 0.7).astype(int)
    d = frame("duration int, event int, x double", [(int(a), int(b), float(c)) for a, b, c in zip(t, e, x)])
    fit = survival.cox(d, ["x"], ties="breslow")
    assert abs(fit.gradient).max() < 1e-6

    def ll(b):
        return sum(b * x[i] - math.log(np.exp(b * x[t >= t[i]]).sum()) for i in range(120) if e[i])

    b = fit.coef[0]
    assert ll(b) >= max(ll(b + 1e-3), ll(b - 1e-3))


def test_longest_missing_run(frame):
    e = frame("company_id long, start_year int, extinction date", [(1, 2000, None)])
    p = frame("company_id long, year int", [(1, 2000), (1, 2004), (1, 2006)])
    r = quality.continuity(p, e, 2000, 2006).first()
    assert (r["missing"], r["longest"], r["points"]) == (4, 3, 3)


def test_linear_fill(frame):
    d = frame("company_id long, year int, x double", [(1, 2000, 10.0), (1, 2001, None), (1, 2002, 30.0), (1, 2003, None)])
    assert [r[0] for r in d.select(align.linear_fill("x")).collect()] == [10.0, 20.0, 30.0, None]


def test_concentration(frame):
    d = frame("company_id long, m string, x double", [(1, "a", 5.0), (2, "a", 3.0), (3, "a", 2.0)])
    r = market.concentration(d, ["m"], "x").first()
    assert round(r["hhi"], 9) == 0.38 and r["cr"] == 1.0


STAGES = [("A", 1, "s"), ("A", 2, "s"), ("A", 3, "g"), ("A", 4, "g"), ("B", 1, "s"), ("B", 2, "g"), ("B", 3, "d")]


def test_transition_matrix(frame):
    d = frame("company_id string, year int, stage string", STAGES)
    assert rows(lifecycle.transition_matrix(d, changes_only=True), "from_stage", "to_stage", "p") == [("g", "d", 1.0), ("s", "g", 1.0)]
    got = {(a, b): p for a, b, p in rows(lifecycle.transition_matrix(d), "from_stage", "to_stage", "p")}
    assert got == {("s", "s"): round(1 / 3, 9), ("s", "g"): round(2 / 3, 9), ("g", "g"): 0.5, ("g", "d"): 0.5}


def test_percentile_of_score(frame):
    d = frame("x double", [(1.0,), (2.0,), (2.0,), (3.0,)])
    r = value_ranks(d, [], "x").where("x = 2").first()
    assert (r["lt"] + r["le"] + 1) / (2 * r["n"]) == 0.625


def test_did(frame):
    d = frame("treated int, after int, y double", [(1, 0, 10.0), (1, 1, 15.0), (0, 0, 8.0), (0, 1, 10.0)])
    assert causal.did_2x2(d, "y").first()["effect"] == 3.0


def test_modified_zscore(frame):
    d = frame("company_id long, year int, metric string, value double", [(i, 2000, "m", v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])])
    r = outliers.modified_zscore(d, ["metric"]).collect()
    assert len(r) == 1 and r[0]["value"] == 100.0 and 0.6745 * 97 / 1 > 65.42


def test_spinoff(frame):
    p = frame("company_id long, year int, revenue double", [(1, 2000, 100.0), (1, 2001, 70.0), (2, 2001, 20.0)])
    ev = frame("parent_id long, child_id long, event_year int, ownership double", [(1, 2, 2001, 0.4)])
    assert rows(clean.spinoff_adjust(p, ev, ["revenue"]), "year", "revenue") == [(2000, 60.0), (2001, 70.0)]
    assert rows(clean.spinoff_consolidate(p, ev, ["revenue"]), "year", "revenue") == [(2000, 100.0), (2001, 78.0)]


def test_benjamini_hochberg(frame):
    d = frame("i int, p double", [(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)])
    assert rows(stats.adjust_p(d), "i", "bh") == [(1, 0.04), (2, 0.04), (3, 0.04), (4, 0.5)]


def test_hot_group_ranks_and_quantiles(frame):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(2000, 7.0), rng.normal(size=4000).round(3)])
    d = frame("g string, x double", [("hot", float(x)) for x in v] + [("cold", 1.0), ("cold", 2.0)])
    r = {(q["g"], q["x"]): q for q in value_ranks(d, ["g"], "x").collect()}
    assert r[("hot", 7.0)]["cnt"] == 2000 and r[("hot", 7.0)]["lt"] == int((v < 7).sum()) and r[("hot", 7.0)]["n"] == 6000
    q = {x["g"]: x for x in exact_quantiles(d, ["g"], "x", {"a": 0.25, "b": 0.9}).collect()}
    assert abs(q["hot"]["a"] - np.quantile(v, 0.25)) < 1e-9 and abs(q["hot"]["b"] - np.quantile(v, 0.9)) < 1e-9 and q["cold"]["a"] == 1.25


def test_running_totals_and_minimum(frame):
    d = frame("o int, x double", [(i, float((i * 7) % 11)) for i in range(50)])
    v = [float((i * 7) % 11) for i in range(50)]
    got = {r["o"]: (r["cum_x"], r["tot_x"]) for r in running_totals(d, [], "o", ["x"]).collect()}
    assert all(got[i] == (sum(v[: i + 1]), sum(v)) for i in range(50))
    low = {r["o"]: r["m"] for r in running_min(d, [], "o", "x", "m").collect()}
    assert all(low[i] == min(v[: i + 1]) for i in range(50))


def test_kendall_and_concordance_against_pairs(frame):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 15, 150), rng.integers(0, 20, 150)
    r = stats.kendall(frame("x int, y int", [(int(a), int(b)) for a, b in zip(x, y)]), "x", "y").first()
    s = [np.sign(int(x[i]) - int(x[j])) * np.sign(int(y[i]) - int(y[j])) for i in range(150) for j in range(i)]
    assert r["concordant"] == s.count(1) and r["discordant"] == s.count(-1)
    e = rng.integers(0, 2, 150)
    d = frame("duration int, event int, k int", [(int(a), int(c), int(b)) for a, b, c in zip(x, y, e)])
    q = survival.concordance(d, "k").first()
    con = sum(1 for i in range(150) for j in range(150) if e[i] and x[i] < x[j] and y[i] > y[j])
    cmp = sum(1 for i in range(150) for j in range(150) if e[i] and x[i] < x[j])
    assert (q["concordant"], q["comparable"]) == (con, cmp)


def test_matching_rules(frame):
    rng = np.random.default_rng(6)
    d = frame("id long, t int, s double, y double", [(i, int(i % 3 == 0), float(v), float(10 * v)) for i, v in enumerate(rng.random(90))])
    m = causal.match_without_replacement(d, "t", "s", "id").collect()
    assert len({r["control"] for r in m}) == len(m) and len({r["treated"] for r in m}) == len(m) == 30
    k = {r["treated"]: r["counterfactual"] for r in causal.kernel_match(d, "t", "s", "y", "id", 0.1).collect()}
    p = {r["id"]: r for r in d.collect()}
    for i, v in k.items():
        wts = [(math.exp(-(((p[i]["s"] - r["s"]) / 0.1) ** 2) / 2), r["y"]) for r in p.values() if r["t"] == 0]
        assert abs(v - sum(a * b for a, b in wts) / sum(a for a, _ in wts)) < 1e-9


def test_fixed_effects_recover_the_slope(frame):
    rng = np.random.default_rng(7)
    data = [(i, t, float(x := rng.normal()), float(2 * x + i + 3 * t)) for i in range(30) for t in range(6) if rng.random() < 0.8]
    fit = regression.fixed_effects(frame("company_id int, year int, x double, y double", data), "y", ["x"])
    assert abs(fit.coef[0] - 2) < 1e-8


def test_two_stage_matches_least_squares_when_exogenous(frame):
    rng = np.random.default_rng(8)
    d = frame("y double, x double", [(float(1 + 3 * x), float(x)) for x in rng.normal(size=50)]).withColumn("z", F.col("x"))
    assert np.allclose(causal.two_stage(d, "y", "x", [], ["z"]).coef, [3, 1])


def test_synthetic_weights_on_the_simplex(frame):
    d = frame("u string, year int, y double", [(u, t, float(v * t + b)) for u, v, b in (("t", 1.5, 5), ("a", 1, 4), ("b", 2, 6)) for t in range(6)])
    wts, gap = causal.synthetic_control(d, "y", "t", "u", 4, ["a", "b"])
    assert abs(sum(wts.values()) - 1) < 1e-9 and abs(wts["a"] - 0.5) < 1e-4
    assert max(abs(r["gap"]) for r in gap.collect()) < 1e-3


def test_components_and_triangles(frame):
    e = frame("src long, dst long, weight double", [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)])
    assert rows(graph.components(e), "node", "label") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    t = {r["node"]: r["triangles"] for r in graph.triangles(e).collect()}
    assert t == {1: 1, 2: 1, 3: 1, 7: 0, 8: 0}
    v = {r["node"]: r["eigenvector"] for r in graph.eigenvector(e, 40).collect()}
    assert abs(v[1] - v[2]) < 1e-6 and v[1] > v[7]


def test_latest_rows_and_similarity(frame):
    d = frame("company_id int, year int, x double", [(1, 1999, 1.0), (1, 2001, 2.0), (2, 1995, None), (3, None, 5.0)])
    assert rows(w.latest_rows(d), "company_id", "year", "x") == [(1, 2001, 2.0), (2, 1995, None)]
    n = frame("node int, seg string, a double, b double", [(1, "s", 1.0, 2.0), (2, "s", 2.0, 4.0), (3, "t", 1.0, 3.0), (4, None, 1.0, 3.0)])
    assert rows(graph.similarity_edges(n, ["a", "b"], "seg"), "src", "dst") == [(1, 2)]
    assert len(rows(graph.similarity_edges(n, ["a", "b"], "seg", 0.0), "src", "dst")) == 6


def test_ks_and_distribution_tails(frame):
    d = frame("x double, g int", [(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)])
    assert ks_distance(d, [], "x", F.col("g") == 0, F.col("g") == 1).first()["ks"] == 1.0
    assert abs(finish.t_two_sided(2.228138852, 10) - 0.05) < 1e-7 and abs(finish.chi2_tail(3.841458821, 1) - 0.05) < 1e-8
    assert abs(finish.f_tail(4.964602744, 1, 10) - 0.05) < 1e-7 and abs(finish.norm_ppf(0.975) - 1.959963985) < 1e-8


def test_weights_average_one_and_bootstrap_is_repeatable(frame):
    d = frame("id long, x double", [(i, float(i % 10)) for i in range(500)])
    a = survival.bootstrap_mean(d, "id", "x", draws=60).first()
    b = survival.bootstrap_mean(d.repartition(7), "id", "x", draws=60).first()
    assert round(a["mean"], 9) == round(b["mean"], 9) and abs(a["mean"] - 4.5) < 0.1


def test_cycle_and_sequence(frame):
    d = frame("company_id int, year int, x double", [(1, 2000 + i, float([0, 1, 0, -1][i % 4])) for i in range(12)])
    r = timeseries.dominant_cycle(d, "x").first()
    assert r["period"] == 4.0 and r["detected"]
    s = timeseries.sequence_windows(d, "x", 3).orderBy("year").first()
    assert list(s["past"]) == [0.0, 1.0, 0.0] and s["target"] == -1.0


def test_growth_curve_choice(frame):
    lin = [(1, 2000 + i, float(i)) for i in range(8)]
    exp = [(2, 2000 + i, math.exp(i * 0.9)) for i in range(8)]
    got = {r["company_id"]: r["curve"] for r in emergence.growth_curves(frame("company_id long, year int, v double", lin + exp), "v").collect()}
    assert got == {1: "linear", 2: "exponential"}


# ---- factor windows by brute force ------------------------------------------------

def _panel(frame, n=9, seed=4):
    from panelspark.schema import AMOUNTS

    rng = np.random.default_rng(seed)
    years = sorted(rng.choice(np.arange(2000, 2014), n, replace=False).tolist())
    data = [(1, int(y), *[float(v) for v in rng.uniform(1, 9, len(AMOUNTS))]) for y in years]
    return frame("company_id long, year int, " + ", ".join(f"{a} double" for a in AMOUNTS), data), years


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factor_windows(frame, seed):
    df, years = _panel(frame, seed=seed)
    raw = {r["year"]: r for r in df.collect()}
    got = {r["year"]: r for r in factors.factors(df, ["growth", "survival", "roe", "succession", "emergence"]).collect()}
    for y in years:
        win = [raw[t] for t in years if y - 5 <= t <= y]
        g = [(b["revenue"] - a["revenue"]) / a["revenue"] for a, b in zip(win, win[1:])]
        want = 1 / (1 + np.std(g)) if len(win) >= 4 and len(g) >= 3 else None
        have = got[y]["survival_08"]
        assert (want is None) == (have is None) and (want is None or abs(want - have) < 1e-9)
        roe = [r["net_profit"] / r["shareholders_equity"] for r in (raw[t] for t in years if y - 3 <= t <= y)]
        want = max(0, min(np.polyfit(range(len(roe)), roe, 1)[0] * 20 + 0.5, 1)) if len(roe) >= 3 else None
        have = got[y]["roe_23"]
        assert (want is None) == (have is None) and (want is None or abs(want - have) < 1e-9)
        rd = [r["rd_expenses"] / r["revenue"] for r in (raw[t] for t in years if y - 7 <= t <= y)]
        if len(rd) >= 5 and y - 1 in raw:
            f = np.abs(np.fft.fft(rd))
            assert abs(got[y]["growth_22"] - min(f[1:len(rd) // 2].max() / len(rd), 1)) < 1e-9
        if y - 3 in raw:
            m = lambda r: r["operating_profit"] / r["revenue"]
            assert abs(got[y]["succession_06"] - (m(raw[y]) / m(raw[y - 3]) - 1)) < 1e-9
        assert got[y]["emergence_02"] is None


def test_families_are_complete():
    assert {k: len(v) for k, v in factors.FAMILIES.items()} == dict.fromkeys(factors.FAMILIES, 23) and len(factors.FAMILIES) == 9
