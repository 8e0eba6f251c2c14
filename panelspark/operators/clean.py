"""Cleaning and imputation of panels.

Entity work uses windows over (entity, period) rows.  Category statistics are
aggregated first and joined back: the aggregate has one row per category and
period, so no category is ever collected in one window partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip, col, ladder, sd, total, with_totals
from ..functions.ranks import long, quantiles_long
from ..functions.windows import W, last_known, next_known, rows, whole, year_lag
from ..session import reliable
from .align import limited_fill, linear_fill

c = F.col


# ---- fills ------------------------------------------------------------------

def fill_time(df: DataFrame, cols: list[str], limit: int | None = None, ffill: int = 0, bfill: int = 0) -> DataFrame:
    """Linear fill inside gaps (at most ``limit`` rows per gap), then limited forward and backward fill."""
    for x in cols:
        known = F.when(c(x).isNotNull(), c("year"))
        lin = linear_fill(x)
        if limit is not None:
            lin = F.coalesce(c(x), F.when(c("year") - last_known(known) <= limit, lin))
        df = df.withColumn(x, lin)
        if ffill:
            df = df.withColumn(x, F.coalesce(c(x), limited_fill(x, ffill)))
        if bfill:
            df = df.withColumn(x, F.coalesce(c(x), limited_fill(x, bfill, forward=False)))
    return df


def peer_means(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("market", "year")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(x).alias(f"_peer_{x}") for x in cols])


def fill_peers(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("market", "year")) -> DataFrame:
    """Category-year mean for nulls."""
    j = df.join(peer_means(df, cols, by), list(by), "left")
    return j.withColumns({x: F.coalesce(c(x), c(f"_peer_{x}")) for x in cols}).drop(*[f"_peer_{x}" for x in cols])


def fill_structural(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero outside the lifetime; half of last year's value in the extinction year, half of the
    category-year mean in the establishment year."""
    j = df.join(peer_means(df, cols), ["market", "year"], "left")
    gone, born = c("extinct_year"), c("start_year")
    out = {}
    for x in cols:
        prev = year_lag(x)
        out[x] = (F.when(gone.isNotNull() & (c("year") > gone), 0.0).when(c("year") < born, 0.0)
                  .when(c(x).isNotNull(), c(x)).when(c("year") == gone, prev * 0.5)
                  .when(c("year") == born, c(f"_peer_{x}") * 0.5))
    return j.select(*[v for v in j.columns if v not in cols and not v.startswith("_peer_")],
                    *[v.alias(k) for k, v in out.items()])


def fill_restructure(df: DataFrame, cols: list[str], event_year: Column) -> DataFrame:
    """Linear value in the event year from the nearest known values on both sides."""
    out = {}
    for x in cols:
        side = F.when(c(x).isNotNull() & (c("year") != event_year), c(x))
        yr = F.when(c(x).isNotNull() & (c("year") != event_year), c("year"))
        p0, p1 = last_known(yr), next_known(yr)
        v0, v1 = last_known(side), next_known(side)
        est = v0 + (v1 - v0) * (c("year") - p0) / F.nullif(p1 - p0, F.lit(0))
        out[x] = F.when(c("year") == event_year, F.coalesce(est, c(x))).otherwise(c(x))
    return df.withColumns(out)


def fill_statistic(df: DataFrame, cols: list[str], how: str = "mean") -> DataFrame:
    """Mean, median, mode or the average of mean and median for nulls, from one aggregate per column."""
    v = long(df, ["company_id"], cols)
    if how == "mode":
        n = v.where(c("value").isNotNull()).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
        st = n.groupBy("metric").agg(F.max_by("value", F.struct("n", -c("value"))).alias("s"))
    else:
        st = v.groupBy("metric").agg(F.avg("value").alias("mean"))
        if how != "mean":
            st = st.join(quantiles_long(df, [], cols, {"median": 0.5}).select("metric", "median"), "metric")
        st = st.withColumn("s", {"mean": c("mean")}.get(how) if how == "mean" else (
            c("median") if how == "median" else (c("mean") + c("median")) / 2.0))
    wide = st.agg(*[F.max(F.when(c("metric") == x, c("s"))).alias(f"_s_{x}") for x in cols])
    return with_totals(df, wide).withColumns({x: F.coalesce(c(x), c(f"_s_{x}")) for x in cols}).drop(
        *[f"_s_{x}" for x in cols])


def fill_model(df: DataFrame, cols: list[str], features: list[str], trees: int = 10, depth: int = 5,
               seed: int = 42) -> DataFrame:
    """Chained forest regressions: each column is predicted from the features and the columns filled so far."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    done = list(features)
    # each forest makes several passes, and its fills are read by all that follow
    df = fill_statistic(reliable(df), features)
    for x in cols:
        vec = VectorAssembler(inputCols=done, outputCol="_f").transform(df)
        model = RandomForestRegressor(featuresCol="_f", labelCol=x, predictionCol="_p", numTrees=trees,
                                      maxDepth=depth, seed=seed).fit(vec.where(c(x).isNotNull()))
        df = reliable(model.transform(vec).withColumn(x, F.coalesce(c(x), c("_p"))).drop("_f", "_p"))
        done.append(x)
    return df


def fill_chained(df: DataFrame, cols: list[str], features: list[str], max_rounds: int = 50, tol: float = 1e-6) -> tuple[DataFrame, int, bool]:
    """Chained regressions: every column on the features and the other columns, round after round until fills settle.

    Fills start at the mean of a column (and stay there for features).  A round fits all columns in one aggregate, each
    on the rows where it was given; the fills of a row then are what these regressions agree on, solved at once for
    each set of columns that are missing together (at most 2^columns sets).  Fills are so plain expressions of the
    given values, and rounds carry numbers only.  They end when no fill moves by more than ``tol`` standard deviations.
    Returns the filled rows, the rounds taken and whether they settled.  A column without any value stays null and
    takes no part.
    """
    st = df.agg(*[f(c(x).cast("double")).alias(f"{p}{i}") for i, x in enumerate([*cols, *features]) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    known = {x: (float(st[f"m{i}"]), float(st[f"s{i}"]) or 1.0) for i, x in enumerate([*cols, *features]) if st[f"m{i}"] is not None}
    cols, features = ([x for x in xs if x in known] for xs in (cols, features))
    if not cols:
        return df, 0, True
    k, names = len(cols), [*cols, *features]
    d = df.withColumns({f"_z{i}": (c(x).cast("double") - known[x][0]) / known[x][1] for i, x in enumerate(names)})
    d = d.withColumn("_gap", total([F.when(c(f"_z{i}").isNull(), 1 << i).otherwise(0) for i in range(k)]))
    d = reliable(d.na.fill(0.0, [f"_z{i}" for i in range(k, len(names))]))
    gaps = [g for g, in d.select("_gap").distinct().orderBy("_gap").collect() if g]

    def solved(b: np.ndarray) -> list[Column]:
        """Values of the columns where row i of ``b`` has the regression of column i: intercept, then all names."""
        out = [c(f"_z{i}") for i in range(k)]
        for g in gaps:
            miss = [i for i in range(k) if g >> i & 1]
            have = [0, *[1 + i for i in range(len(names)) if not (i < k and g >> i & 1)]]
            w = np.linalg.pinv(np.eye(len(miss)) - b[np.ix_(miss, [1 + i for i in miss])]) @ b[np.ix_(miss, have)]
            for i, row in zip(miss, w):
                v = total([F.lit(float(row[0])), *[c(f"_z{h - 1}") * float(q) for h, q in zip(have[1:], row[1:])]])
                out[i] = F.when(c("_gap") == g, v).otherwise(out[i])
        return out

    now = before = [F.coalesce(c(f"_z{i}"), F.lit(0.0)) for i in range(k)]
    rounds, settled = 0, not gaps
    while not settled:
        e = d.select("_gap", *[v.alias(f"v{i}") for i, v in enumerate(now)], *[c(f"_z{i}").alias(f"v{i}") for i in range(k, len(names))], *[v.alias(f"u{i}") for i, v in enumerate(before)])
        v = [F.lit(1.0), *[c(f"v{i}") for i in range(len(names))]]
        pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
        given = [(c("_gap").bitwiseAND(1 << t)) == 0 for t in range(k)]
        r = e.agg(*[F.sum(F.when(given[t], v[i] * v[j])).alias(f"m{t}_{i}_{j}") for t in range(k) for i, j in pairs], *[F.max(F.abs(c(f"v{i}") - c(f"u{i}"))).alias(f"d{i}") for i in range(k)]).first()
        if rounds and max(r[f"d{i}"] for i in range(k)) <= tol or rounds == max_rounds:
            settled = max(r[f"d{i}"] for i in range(k)) <= tol
            break
        b = np.zeros((k, 1 + len(names)))
        for t in range(k):
            m = np.array([[r[f"m{t}_{min(i, j)}_{max(i, j)}"] for j in range(len(v))] for i in range(len(v))], float)
            own = [i for i in range(len(v)) if i != 1 + t]
            b[t, own] = np.linalg.pinv(m[np.ix_(own, own)]) @ m[own, 1 + t]
        before, now, rounds = now, solved(b), rounds + 1
    out = d.withColumns({x: F.coalesce(c(x).cast("double"), now[i] * known[x][1] + known[x][0]) for i, x in enumerate(cols)})
    return out.drop("_gap", *[f"_z{i}" for i in range(len(names))]), rounds, settled


def fill_regression(df: DataFrame, target: str, features: list[str], min_rows: int = 50) -> DataFrame:
    """Least squares on known rows; unchanged when at most ``min_rows`` rows are complete."""
    from .regression import ols

    known = df.where(c(target).isNotNull())
    fit = ols(known, target, features)
    if fit is None or fit.n <= min_rows:
        return df
    pred = total([F.lit(float(b)) * col(x) for b, x in zip(fit.coef[1:], features)]) + float(fit.coef[0])
    return df.withColumn(target, F.coalesce(c(target), pred))


def impute(df: DataFrame, cols: list[str], strategy: str = "conservative") -> DataFrame:
    """Composed strategies; each later one fills what the earlier steps left."""
    df = fill_structural(df, cols)
    if strategy == "conservative":
        return fill_time(df, cols, limit=1)
    df = fill_time(df, cols, limit=5, ffill=2, bfill=0 if strategy == "comprehensive" else 2)
    df = fill_peers(df, cols)
    return df if strategy == "comprehensive" else fill_statistic(df, cols, "median")


def drop_sparse(df: DataFrame, cols: list[str], limit: float = 0.5) -> DataFrame:
    """Drop the columns whose null share exceeds the limit (one aggregate row decides)."""
    share = df.agg(*[F.avg(c(x).isNull().cast("int")).alias(x) for x in cols]).first()
    return df.drop(*[x for x in cols if share[x] is not None and share[x] > limit])


# ---- labels and weights ------------------------------------------------------

def age_bin(age: Column, bounds: tuple[int, ...] = (5, 15, 30), inclusive: bool = False,
            names: tuple[str, ...] = ("startup", "growth", "mature", "established")) -> Column:
    return ladder([((age <= b) if inclusive else (age < b), n) for b, n in zip(bounds, names)], names[-1])


def status_weight(df: DataFrame, status: str = "status") -> DataFrame:
    """1 / share of the status among all rows (one row per status joined back)."""
    g = df.groupBy(status).agg(F.count(F.lit(1)).alias("_n"))
    g = with_totals(g, g.agg(F.sum("_n").alias("_t")))
    return df.join(g.select(status, (c("_t") / c("_n")).alias("status_weight")), status)


def accounting_tag(df: DataFrame, transition: int) -> DataFrame:
    return df.withColumn("accounting_standard", F.when(c("year") >= transition, "IFRS").otherwise("JGAAP"))


def fix_jumps(df: DataFrame, cols: list[str], hi: float = 10.0, lo: float = -0.9) -> DataFrame:
    """Replace rows with impossible growth by the mean of their neighbours."""
    out = {}
    for x in cols:
        p, n = F.lag(x).over(W()), F.lead(x).over(W())
        g = c(x) / F.nullif(p, F.lit(0.0)) - 1.0
        out[x] = F.when(((g > hi) | (g < lo)) & n.isNotNull(), (p + n) / 2.0).otherwise(c(x))
    return df.withColumns(out)


def exit_phase(df: DataFrame, lost: list[str], k: int = 3) -> DataFrame:
    """Flag the last k years of entities in lost markets."""
    return df.withColumn("exit_phase", c("market").isin(lost) & (c("year") > F.max("year").over(whole()) - k))


# ---- clipping and scaling ----------------------------------------------------

def clip_iqr(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Clip every column to its global k x IQR fences."""
    q = quantiles_long(df, [], cols, {"q1": 0.25, "q3": 0.75})
    wide = q.agg(*[F.max(F.when(c("metric") == x, c("q1") - k * (c("q3") - c("q1")))).alias(f"_l_{x}") for x in cols],
                 *[F.max(F.when(c("metric") == x, c("q3") + k * (c("q3") - c("q1")))).alias(f"_h_{x}") for x in cols])
    d = with_totals(df, wide)
    return d.withColumns({x: F.when(c(x).isNotNull(), F.least(F.greatest(c(x), c(f"_l_{x}")), c(f"_h_{x}")))
                          for x in cols}).drop(*[f"_l_{x}" for x in cols], *[f"_h_{x}" for x in cols])


def clip_z(df: DataFrame, cols: list[str], t: float = 3.0) -> DataFrame:
    """Clip every column to mean +- t standard deviations."""
    st = df.agg(*[F.avg(x).alias(f"_m_{x}") for x in cols], *[F.stddev_samp(x).alias(f"_s_{x}") for x in cols])
    d = with_totals(df, st)
    return d.withColumns({x: F.when(c(x).isNotNull(), F.least(F.greatest(c(x), c(f"_m_{x}") - t * c(f"_s_{x}")),
                                                              c(f"_m_{x}") + t * c(f"_s_{x}"))) for x in cols}).drop(
        *[f"_m_{x}" for x in cols], *[f"_s_{x}" for x in cols])


def winsorize(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Infinite values to zero, then clip to the lo / hi quantiles."""
    inf = float("inf")
    df = df.withColumns({x: F.when(c(x).isin(inf, -inf), 0.0).otherwise(c(x)) for x in cols})
    q = quantiles_long(df, [], cols, {"lo": lo, "hi": hi})
    wide = q.agg(*[F.max(F.when(c("metric") == x, c(b))).alias(f"_{b}_{x}") for x in cols for b in ("lo", "hi")])
    return with_totals(df, wide).withColumns(
        {x: F.when(c(x).isNotNull(), F.least(F.greatest(c(x), c(f"_lo_{x}")), c(f"_hi_{x}"))) for x in cols}).drop(
        *[f"_{b}_{x}" for x in cols for b in ("lo", "hi")])


def peer_zscore(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Sample z-score inside the category; moments aggregated, then joined."""
    st = df.groupBy(*by).agg(*[F.avg(x).alias(f"_m_{x}") for x in cols],
                             *[F.stddev_samp(x).alias(f"_s_{x}") for x in cols])
    return df.join(st, list(by)).withColumns({f"{x}_zscore": sd(c(x) - c(f"_m_{x}"), f"_s_{x}") for x in cols}).drop(
        *[f"_m_{x}" for x in cols], *[f"_s_{x}" for x in cols])


def robust_scale(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("market",)) -> DataFrame:
    """(x - median) / IQR inside the category with exact quantiles."""
    q = quantiles_long(df, list(by), cols, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.groupBy(*by).agg(*[F.max(F.when(c("metric") == x, c(b))).alias(f"_{b}_{x}")
                                for x in cols for b in ("q1", "q2", "q3")])
    return df.join(wide, list(by)).withColumns(
        {f"{x}_scaled": sd(c(x) - c(f"_q2_{x}"), c(f"_q3_{x}") - c(f"_q1_{x}")) for x in cols}).drop(
        *[f"_{b}_{x}" for x in cols for b in ("q1", "q2", "q3")])


# ---- lifecycle normalization ---------------------------------------------------

# fixed values: volatility by stage, sensitivity by metric, entry factor
STAGE_VOLATILITY = {"startup": 2.0, "growth": 1.5, "maturity": 1.0, "mature": 0.8, "decline": 1.8}
METRIC_SENSITIVITY = {"revenue": 0.8, "revenue_growth": 1.5, "operating_margin": 1.2, "net_margin": 1.3, "roe": 1.4,
                      "value_added_ratio": 1.0, "survival_probability": 2.0, "new_business_success": 2.5,
                      "succession_score": 1.8}
ENTRY_FACTOR = {"pioneer": 1.5, "early_adopter": 1.2, "follower": 1.0, "late_entrant": 0.8}


def mapped(key: Column, table: dict[str, float], default: float = 1.0) -> Column:
    return ladder([(key == k, v) for k, v in table.items()], default)


def year_stage(age: Column, extinct: Column, spinoff_age: Column, growth: Column | None = None,
               profit: Column | None = None) -> Column:
    """Stage by age 5/15/30/50; extinct and young spin-offs first; old entities may be overridden."""
    base = ladder([(age <= 5, "startup"), (age <= 15, "growth"), (age <= 30, "maturity"), (age <= 50, "mature")], "decline")
    if growth is not None:
        base = ladder([((age > 30) & (growth > 0.15) & (profit > 0.1), "revival"),
                       ((age > 30) & ((growth < -0.1) | (profit < 0)), "decline")], base)
    return ladder([(F.coalesce(extinct, F.lit(False)), "extinction"), (spinoff_age <= 5, "revival")], base)


def entry_timing(entry_year: Column, market_start: Column) -> Column:
    lag = entry_year - market_start
    return ladder([(lag <= 10, "pioneer"), (lag <= 20, "early_adopter"), (lag <= 40, "follower")], "late_entrant")


def lifecycle_normalize(df: DataFrame, cols: list[str], stage: str = "life_stage", timing: str = "timing") -> DataFrame:
    """Population z-score over volatility x sensitivity x entry factor; linear decay or recovery for
    extinct and revived entities."""
    w = whole()
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(W()) - 1
    pos = F.when(n > 1, i / (n - 1)).otherwise(0.0)
    out = {}
    for x in cols:
        adj = mapped(c(stage), STAGE_VOLATILITY) * METRIC_SENSITIVITY.get(x, 1.0) * mapped(c(timing), ENTRY_FACTOR)
        s = F.stddev_pop(x).over(w)
        z = F.when((n > 1) & (s > 0), (c(x) - F.avg(x).over(w)) / F.nullif(s, F.lit(0.0)) / adj).otherwise(c(x))
        out[f"{x}_norm"] = F.when(c(stage) == "extinction", c(x) * (1.0 - 0.9 * pos)).when(
            c(stage) == "revival", c(x) * (0.3 + 0.9 * pos)).otherwise(z)
    return df.select("*", *[v.alias(k) for k, v in out.items()])


def stage_benchmarks(df: DataFrame, cols: list[str], stage: str = "stage") -> DataFrame:
    """Mean, median, std, quartiles, min, max and count per stage and metric."""
    base = long(df, [stage], cols).groupBy(stage, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("lo"),
        F.max("value").alias("hi"), F.count("value").alias("n"))
    q = quantiles_long(df, [stage], cols, {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n")
    return base.join(q, [stage, "metric"])


# ---- spin-offs and external sources ----------------------------------------------

def spinoff_adjust(parent: DataFrame, events: DataFrame, cols: list[str]) -> DataFrame:
    """Parent amounts before the event times (1 - ownership)."""
    ev = events.select(c("parent_id").alias("company_id"), "event_year", "ownership")
    before = c("year") < c("event_year")
    j = parent.join(ev, "company_id")
    return j.withColumns({x: F.when(before, c(x) * (1.0 - c("ownership"))).otherwise(c(x)) for x in cols})


def spinoff_consolidate(panel: DataFrame, events: DataFrame, cols: list[str]) -> DataFrame:
    """Parent rows before the event, parent + child x ownership on common years from the event on."""
    ev = events.select("parent_id", "child_id", "event_year", "ownership")
    p = panel.select(c("company_id").alias("parent_id"), "year", *cols).join(ev, "parent_id")
    child = panel.select(c("company_id").alias("child_id"), "year", *[c(x).alias(f"_c_{x}") for x in cols])
    keys = ["parent_id", "child_id", "year"]
    pre = p.where(c("year") < c("event_year")).select(*keys, *cols)
    post = p.where(c("year") >= c("event_year")).join(child, ["child_id", "year"]).select(
        *keys, *[(c(x) + c(f"_c_{x}") * c("ownership")).alias(x) for x in cols])
    return pre.withColumn("part", F.lit("pre")).unionByName(post.withColumn("part", F.lit("post")))


def continuity_across(df: DataFrame, cols: list[str], key: list[str], k: int = 4, limit: float = 0.5) -> DataFrame:
    """Means of the last k rows before and first k rows after the event; fails above the change limit."""
    side = c("year") >= c("event_year")
    after = Window.partitionBy(*key, side).orderBy("year")
    before = Window.partitionBy(*key, side).orderBy(F.desc("year"))
    d = df.withColumn("_after", side).withColumn(
        "_n", F.when(side, F.row_number().over(after)).otherwise(F.row_number().over(before))).where(c("_n") <= k)
    g = d.groupBy(*key).agg(*[F.avg(F.when(c("_after") == s, c(x))).alias(f"_{int(s)}_{x}")
                              for x in cols for s in (False, True)])
    for x in cols:
        g = g.withColumn(f"change_{x}", F.when(c(f"_0_{x}") > 0, F.abs(c(f"_1_{x}") - c(f"_0_{x}")) / c(f"_0_{x}")))
    bad = total([F.coalesce(c(f"change_{x}") > limit, F.lit(False)).cast("int") for x in cols])
    complete = c(f"_0_{cols[0]}").isNotNull() & c(f"_1_{cols[0]}").isNotNull()
    return g.withColumn("continuous", complete & (bad == 0)).drop(*[f"_{s}_{x}" for x in cols for s in (0, 1)])


def subsidiary_estimate(parent: DataFrame, ratios: DataFrame, cols: list[str], default: float = 0.1) -> DataFrame:
    """Parent columns times the subsidiary's ratio (.1 when unknown)."""
    j = parent.join(ratios.select("company_id", "subsidiary_id", "ratio"), "company_id")
    r = F.coalesce(c("ratio"), F.lit(default))
    return j.select("subsidiary_id", "year", *[(c(x) * r).alias(x) for x in cols])


def sector_benchmark(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("market", "year"), k: int = 3) -> DataFrame:
    """Ratio to the sector mean, k-row moving average and survival flag."""
    j = df.join(peer_means(df, cols, by), list(by))
    return j.select(*df.columns, *[sd(x, f"_peer_{x}").alias(f"{x}_to_sector") for x in cols],
                    *[F.avg(x).over(rows(k)).alias(f"{x}_ma{k}") for x in cols],
                    (c("status") == "active").alias("survives"))


def first_available(df: DataFrame, keys: list[str], source: str, value: str, priority: list[str]) -> DataFrame:
    """First available source per key by priority, without pivoting rows to the driver."""
    g = df.groupBy(*keys).agg(*[F.max(F.when(c(source) == s, c(value))).alias(f"_{i}") for i, s in enumerate(priority)])
    names = [f"_{i}" for i in range(len(priority))]
    used = ladder([(c(n).isNotNull(), s) for n, s in zip(names, priority)], F.lit(None).cast("string"))
    return g.select(*keys, F.coalesce(*[c(n) for n in names]).alias(value), used.alias("source"))


def best_reliability(df: DataFrame, keys: list[str], cols: list[str], reliability: str = "reliability") -> DataFrame:
    """Per key and column the value of the most reliable source that has one."""
    return df.groupBy(*keys).agg(*[
        F.max_by(c(x), F.when(c(x).isNotNull(), c(reliability))).alias(x) for x in cols])
