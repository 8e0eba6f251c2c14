"""Large-table rules, continued: entry patterns take one pass over the panel and write a row per entity."""

import math

import pytest

from panelspark.operators import market
from panelspark.session import reliable
from panelspark.sources import derive

READS = "company_id long, market string, year int, revenue double, margin double, total_assets double, capex_ratio double, rd_ratio double, ad_ratio double, status string"


def counted(df):
    """``df`` behind a step that counts the rows it hands out, and the count."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def step(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(step, df.schema), seen


def odd_panel():
    """Gaps, ties, rows without revenue or margin, losses, entities too short to score and one of twelve years."""
    rows = []
    for i in range(40):
        for y in range(1990 + i % 3, 1990 + i % 3 + (12 if i == 7 else 2 + i % 6)):
            if (i + y) % 11:
                v = None if (i, y) == (9, 1992) else float((i * 37 + y * 101) % 13 - (2 if i % 5 == 0 else -1))
                rows.append((i, "AB"[i % 2], y, v, None if i % 9 == 0 else float((i + y) % 5 - 2), 10.0, float(i), float(i % 7), float(i % 4), "active"))
    return rows


def score(rows):
    """entry_success row by row."""
    ent, out = {}, {}
    for r in rows:
        ent.setdefault(r[0], []).append(r)
    for i, rs in ent.items():
        rs.sort(key=lambda r: r[2])
        n, a, z, first = len(rs), rs[0][3], rs[-1][3], rs[:10]
        if n < 5 or z is None:
            continue
        peers = [r[3] for r in rows if r[2] == rs[-1][2] and r[3] is not None]
        lt, le = sum(x < z for x in peers), sum(x <= z for x in peers)
        # the last of the first ten rows
        t = first[-1][3]
        grow = min(1, max(0, (t / a) ** (1 / len(first)) - 1)) if a is not None and t is not None and a > 0 and t > 0 else 0
        py = min((r[2] for r in rs if r[4] is not None and r[4] > 0), default=None)
        prof = 0 if py is None else max(0, 1 - (py - rs[0][2]) / 10)
        out[i] = 0.3 * grow + 0.3 * prof + 0.25 * (lt + le + 1) / (2 * len(peers)) + 0.15 * min(1, n / 20)
    return out


def test_entry_success_is_the_same_with_and_without_entity_rows(spark):
    rows = odd_panel()
    d = spark.createDataFrame(rows, READS)
    want = score(rows)
    assert len(want) > 8
    for e in (None, market.entrants(d)):
        got = {r["company_id"]: r["success"] for r in market.entry_success(d, entities=e).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)
    a, b = (market.entry_profile(d, entities=e) for e in (None, market.entrants(d)))
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_entry_patterns_read_the_panel_once_and_write_entities(spark, monkeypatch):
    from panelspark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    p = derive.competition(spark, sf)
    want = market.entry_patterns(market.entry_profile(p), market.entry_success(p), 0.55, 0.45).collect()
    source, seen = counted(p)
    written = []
    monkeypatch.setattr(derive, "competition", lambda *a, **k: source)
    monkeypatch.setattr(market, "reliable", lambda df: written.append(reliable(df)) or written[-1])
    got = catalogue()["entry_patterns"].run(spark, sf).collect()
    assert seen.value == p.count()
    # neither the panel's rows nor its sixty columns
    assert [x.count() for x in written] == [p.select("company_id").distinct().count()]
    key = lambda r: (r["outcome"], r["entry_type"])
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]
    for r, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert r["n"] == w["n"] and tuple(r[3:]) == pytest.approx(tuple(w[x] for x in ("success", "cagr", "early_profit_share")), abs=2e-6)


def test_entry_patterns_scan_line_items_once(spark, monkeypatch):
    from panelspark.plans import catalogue

    plans = []
    monkeypatch.setattr(market, "reliable", lambda df: plans.append(df._jdf.queryExecution().toString()) or reliable(df))
    out = catalogue()["entry_patterns"].run(spark, "/root/testdata/sf0.001")
    plans.append(out._jdf.queryExecution().toString())
    physical = [x[x.index("== Physical Plan =="):] for x in plans]
    assert sum(x.count("lineitem.parquet") for x in physical) == 1
