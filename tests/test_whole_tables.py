"""Queries read their markets, years and short series from the table."""

import datetime

import pytest

from panelspark.plans import survival as plans
from panelspark.sources import derive
from __spark_entry__ import queries

MARKETS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SHIPPING"]


@pytest.fixture()
def subjects(frame, monkeypatch):
    x = [(10 * i + j, m, 100 + (37 * i + 61 * j) % 90, int(j % 3 > 0), float((13 * j + i) % 11)) for i, m in enumerate(MARKETS) for j in range(12)]
    df = frame("company_id long, market string, duration int, event int, balance_k double", [*x, (900, "TINY", 50, 1, 1.0), (901, "QUIET", 60, 0, 1.0), (902, None, 60, 1, 1.0)])
    monkeypatch.setattr(derive, "survival", lambda spark, sf: df)
    monkeypatch.setattr(plans, "subjects", lambda spark, sf: df)
    return df


def test_log_rank_takes_all_markets(spark, subjects):
    q = queries()
    assert q["logrank_k_sample"](spark, "").first()["df"] == 7
    pairs = {(r.a, r.b) for r in q["logrank_pairs"](spark, "").collect()}
    every = sorted([*MARKETS, "TINY", "QUIET"])
    assert pairs == {(a, b) for a in every for b in every if a < b}


def test_cox_takes_all_markets(spark, subjects):
    got = {r.market: r.hr for r in queries()["cox_market_hazards"](spark, "").collect()}
    assert set(got) == {*MARKETS, "TINY", "QUIET"} and all(got[m] for m in MARKETS) and got["QUIET"] is None


def panel(frame):
    return frame("company_id long, market string, year int, revenue double", [(i, m, y, 100.0 + 7 * i * (y - 1994) + y % (i + 2)) for i, m in enumerate(MARKETS) for y in range(1995, 2003)]
                 + [(50, "LATE", 2001, 5.0)])


def test_synthetic_control_takes_all_markets(spark, frame, monkeypatch):
    rows = [(0, "BUILDING", y, float(y % 5 + 1)) for y in range(1995, 2002)] + [(1, "SHIPPING", y, float(y % 5 + 1)) for y in range(1995, 2002)]
    rows += [(2, "FURNITURE", y, 9.0 - y % 3) for y in range(1995, 2002)] + [(3, "LATE", 2001, 5.0)]
    df = frame("company_id long, market string, year int, revenue double", rows)
    monkeypatch.setattr(derive, "mpanel", lambda spark, sf: df)
    got = queries()["synthetic_control"](spark, "").collect()
    assert len(got) == 7 and all(abs(r.gap) < 1e-3 for r in got)


@pytest.mark.parametrize("last, years", [(datetime.date(2002, 12, 31), 8), (datetime.date(2002, 7, 1), 7)])
def test_scenarios_take_all_whole_years(spark, frame, monkeypatch, last, years):
    from panelspark.operators import cluster

    seen = []
    monkeypatch.setattr(derive, "mpanel", lambda spark, sf: panel(frame))
    monkeypatch.setattr(derive, "table", lambda spark, sf, name: frame("o_orderdate date", [(last,), (datetime.date(1999, 1, 1),)]))
    monkeypatch.setattr(cluster, "simulate", lambda u, *a: seen.append({r.market: r.mu for r in u.collect()}) or u)
    monkeypatch.setattr(cluster, "scenario_summary", lambda u, *a: u.selectExpr("market", "'x' AS scenario", *[f"mu AS {v}" for v in "mean p05 p50 p95 value_at_risk shortfall extinction".split()]))
    queries()["scenario_simulation"](spark, "").collect()
    r = [x[3] for x in panel(frame).where("market = 'SHIPPING'").orderBy("year").collect()][:years]
    assert abs(seen[0]["SHIPPING"] - sum(b / a - 1 for a, b in zip(r, r[1:])) / (years - 1)) < 1e-12


def test_trajectories_keep_short_series(spark, frame, monkeypatch):
    rows = [(i, y, float((i * 7 + y * (i % 4)) % 50 + 1)) for i in range(30) for y in range(1995, 1996 + i % 6)]
    monkeypatch.setattr(derive, "panel", lambda spark, sf: frame("company_id long, year int, revenue double", rows))
    got = queries()["trajectory_clusters"](spark, "").collect()
    assert sorted(r.company_id for r in got) == list(range(30))
