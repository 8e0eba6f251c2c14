"""Hot keys, bounded top-k, bookkeeping operators."""

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import cluster, evaluation, events, factors, market, outliers, quality, stats
from panelspark.sources.derive import exact_sum


def test_sessions_of_a_hot_user(frame):
    rng = np.random.default_rng(9)
    data = [(i, 1 if i % 3 else int(2 + i % 50), int(t)) for i, t in enumerate(np.sort(rng.integers(0, 200_000, 3000)))]
    d = frame("event_id long, user_id int, s long", data).withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["session"] for r in events.sessionize(d, "user_id", "ts", "event_id", 60).collect()}
    last, num = {}, {}
    for i, u, t in sorted(data, key=lambda r: (r[2], r[0])):
        num[u] = num.get(u, 0) + (u not in last or t - last[u] >= 60)
        last[u] = t
        assert got[i] == num[u]


def test_as_of_of_a_hot_key(frame):
    rng = np.random.default_rng(10)
    left = [(1 if i % 3 else 2, int(t), i) for i, t in enumerate(rng.integers(0, 5000, 600))]
    right = [(1 if i % 2 else 2, int(t), float(i)) for i, t in enumerate(rng.choice(5000, 300, replace=False))]
    r = events.as_of(frame("k int, t int, i int", left), frame("k int, t int, x double", right), ["k"], "t", ["x"])
    got = {q["i"]: q["x"] for q in r.collect()}
    assert len(got) == 600
    for k, t, i in left:
        c = [(b, x) for a, b, x in right if a == k and b <= t]
        assert got[i] == (max(c)[1] if c else None)


def test_top_k_of_a_hot_group(frame):
    d = frame("company_id int, m string, x double", [(i, "hot" if i % 5 else "cold", float((i * 37) % 101)) for i in range(400)])
    want = {}
    for r in d.collect():
        want.setdefault(r["m"], []).append((-r["x"], r["company_id"]))
    got = {}
    for r in market.top_k(d, ["m"], "x", 3).collect():
        got.setdefault(r["m"], []).append((-r["x"], r["company_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}


def test_exact_sum_beyond_long(frame):
    big = 9_000_000_000_000_000_000
    d = frame("v long", [(big,), (big,), (7,)])
    assert int(d.agg(exact_sum(F.col("v")).alias("s")).first()["s"]) == 2 * big + 7


def test_dedup_keeps_the_first(frame):
    d = frame("k int, t int, v string", [(1, 2, "b"), (1, 1, "a"), (2, 5, "c")])
    assert sorted((r["k"], r["v"]) for r in quality.dedup(d, ["k"], [F.col("t")]).collect()) == [(1, "a"), (2, "c")]


def test_folds_and_tracker(frame):
    d = frame("company_id int, g string", [(i, "a" if i < 70 else "b") for i in range(100)])
    n = {(r["g"], r["fold"]): r["n"] for r in evaluation.stratified_fold(d, "company_id", "g", 5).groupBy("g", "fold").agg(F.count("*").alias("n")).collect()}
    assert all(v == (14 if g == "a" else 6) for (g, _), v in n.items()) and len(n) == 10
    h = frame("model string, run_id long, score double", [("m", 1, 0.5), ("m", 2, 0.7)])
    r = evaluation.track(h, frame("model string, run_id long, score double", [("m", 3, 0.6)])).first()
    assert (r["run_id"], r["runs"]) == (2, 3)


def test_factor_rename_map(frame):
    from panelspark.schema import AMOUNTS

    cols = ["sales" if a == "revenue" else a for a in AMOUNTS]
    d = frame("company_id long, year int, " + ", ".join(f"{a} double" for a in cols), [(1, 2000, *[2.0] * len(cols)), (1, 2001, *[3.0] * len(cols))])
    r = factors.factors(d, ["rev", "growth"], rename={"sales": "revenue"}).orderBy("year").collect()
    assert r[0]["growth_01"] is None and r[1]["growth_01"] == 0.5 and r[1]["rev_14"] == 1.0


def test_treatments(frame):
    v = frame("company_id long, year int, metric string, value double", [(1, 1, "m", 10.0), (1, 2, "m", 30.0), (1, 3, "m", 12.0)])
    f = frame("company_id long, year int, metric string, severity double, action string", [(1, 2, "m", 0.9, "transform"), (1, 3, "m", 0.9, "remove")])
    assert [(r["year"], r["value"]) for r in outliers.treat(v, f, "aggressive").orderBy("year").collect()] == [(1, 10.0), (2, 20.0)]


def test_anova_by_hand(frame):
    d = frame("g string, y double", [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)])
    r = stats.anova(d, "g", "y")
    assert abs(r["f"] - 1.5) < 1e-12 and abs(r["eta2"] - 1.5 / 5.5) < 1e-12


def test_scenarios_do_not_depend_on_partitioning(frame):
    u = frame("m string, mu double, sigma double", [("a", 0.05, 0.1), ("b", 0.0, 0.2)])
    s = lambda x: sorted((r["m"], r["scenario"], round(r["p50"], 9)) for r in cluster.scenario_summary(cluster.simulate(x, "m", 50, 3), "m", 3).collect())
    assert s(u) == s(u.repartition(5)) and len(s(u)) == 8
