"""Synthetic difference in differences and group-time effects.

Rows are reduced to one mean for each unit (a market, a region, a cohort) and period; only that table is used further.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finish
from .causal import simplex_projection

c = F.col


# ---- synthetic difference in differences ------------------------------------------------------

def simplex_fit(x: np.ndarray, target: np.ndarray, ridge: float, tol: float = 1e-12, max_iter: int = 200_000) -> np.ndarray:
    """Weights on the simplex with a free intercept: least |x w + const - target|^2 + ridge |w|^2.

    Accelerated projected gradient on the k x k matrix; the intercept is removed by centring the columns.
    """
    x, target = x - x.mean(axis=0), target - target.mean()
    g, b, k = x.T @ x + ridge * np.eye(x.shape[1]), x.T @ target, x.shape[1]
    step = 1.0 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-300)
    w = v = np.full(k, 1.0 / k)
    t = 1.0
    for _ in range(max_iter):
        n = simplex_projection(v - step * (g @ v - b))
        if (n - w) @ (v - n) > 0:  # the momentum overshot
            t = 1.0
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, moved, w, t = n + (t - 1) / t2 * (n - w), float(np.abs(n - w).max()), n, t2
        if moved < tol:
            break
    return w


def estimate(y: np.ndarray, treated: np.ndarray, pre: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Effect, weights of the control units and weights of the earlier periods, from a units x periods table."""
    co, tr = y[~treated], y[treated]
    post = y.shape[1] - pre
    noise = np.diff(co[:, :pre], axis=1)
    sigma = float(noise.std(ddof=1)) if noise.size > 1 else 0.0
    zeta = (len(tr) * post) ** 0.25 * sigma
    omega = simplex_fit(co[:, :pre].T, tr[:, :pre].mean(axis=0), zeta * zeta * pre)
    lam = simplex_fit(co[:, :pre], co[:, pre:].mean(axis=1), (1e-6 * sigma) ** 2 * len(co))
    change = y[:, pre:].mean(axis=1) - y[:, :pre] @ lam
    return float(change[treated].mean() - omega @ change[~treated]), omega, lam


def unit_means(df: DataFrame, y: str, unit: str, period: str) -> DataFrame:
    return df.where(c(y).isNotNull() & c(unit).isNotNull() & c(period).isNotNull()).groupBy(unit, period).agg(F.avg(y).alias("mean"))


def synthetic_did(df: DataFrame, y: str, unit: str, period: str, treated: list, start: int, most_units: int = 5000) -> dict:
    """Effect on the treated units from ``start`` on, its placebo error and both sets of weights.

    ``df`` may be rows of any number; units are aggregates, and more than ``most_units`` of them raise an error, as
    weights come from a matrix of all control units.  A control unit without a mean in every period can't be weighted
    and is named in ``left_out``; a treated one without raises an error.  The error is the deviation of the effects
    found when each control unit in turn is taken for treated; with fewer than three control units there is none.
    """
    cells = unit_means(df, y, unit, period)
    n = cells.select(unit).distinct().count()
    if n > most_units:
        raise ValueError(f"{n} units; aggregate them to at most {most_units}")
    rows = cells.collect()  # one for each unit and period
    periods = sorted({r[period] for r in rows})
    pre = sum(p < start for p in periods)
    if pre < 2 or pre == len(periods):
        raise ValueError("two periods before the start and one from it on are needed")
    at = {(r[unit], r[period]): r["mean"] for r in rows}
    units = sorted({r[unit] for r in rows})
    whole = [u for u in units if all((u, p) in at for p in periods)]
    if missing := [u for u in treated if u not in whole]:
        raise ValueError(f"treated units without a mean in every period: {missing}")
    mark = np.array([u in treated for u in whole])
    if (~mark).sum() < 2:
        raise ValueError("two control units are needed")
    table = np.array([[at[u, p] for p in periods] for u in whole], float)
    effect, omega, lam = estimate(table, mark, pre)
    control = table[~mark]
    placebo = [estimate(control, np.arange(len(control)) == i, pre)[0] for i in range(len(control))] if len(control) > 2 else []
    se = float(np.std(placebo)) if placebo else None
    names = [u for u, m in zip(whole, mark) if not m]
    return {"effect": effect, "se": se, "p": finish.norm_two_sided(effect / se) if se else None, "placebo": dict(zip(names, placebo)),
            "unit_weights": dict(zip(names, map(float, omega))), "period_weights": dict(zip(periods[:pre], map(float, lam))), "left_out": [u for u in units if u not in whole]}


# ---- group-time effects --------------------------------------------------------------------------

def cohort_cells(df: DataFrame, y: str) -> DataFrame:
    """Sum and count for each cohort (``treat_year``, null: never treated) and year."""
    return df.where(c(y).isNotNull()).groupBy(c("treat_year").alias("cohort"), "year").agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))


def group_time_effects(df: DataFrame, y: str) -> DataFrame:
    """Effect on each cohort in each year, against those not treated yet, from one aggregate.

    The base is the year before the cohort's treatment.  Controls of (cohort, year) are the never treated and the
    cohorts treated after both that year and the base.  A cohort without a base year, or without controls, has no row.
    """
    cells = cohort_cells(df, y)
    own = cells.where("cohort is not null")
    base = own.where("year = cohort - 1").select("cohort", (c("s") / c("n")).alias("y0"))
    own = own.join(base, "cohort").select("cohort", "year", (c("s") / c("n")).alias("y1"), "y0", c("n").alias("n_treated"))
    last = F.greatest(c("year"), c("cohort") - 1)
    ctl = cells.select(c("cohort").alias("h"), c("year").alias("u"), c("s").alias("cs"), c("n").alias("cn"))
    free = c("h").isNull() | ((c("h") > last) & (c("h") != c("cohort")))

    def control(name: str, when) -> DataFrame:
        """Mean of the controls of each (cohort, year) in the year ``when``; cells number cohorts x years."""
        return own.join(ctl, (c("u") == when) & free).groupBy("cohort", "year").agg((F.sum("cs") / F.sum("cn")).alias(name), F.sum("cn").alias(f"n_{name}"))

    j = own.join(control("c1", c("year")), ["cohort", "year"]).join(control("c0", c("cohort") - 1), ["cohort", "year"])
    return j.select("cohort", "year", (c("year") - c("cohort")).alias("since"), "n_treated", c("n_c1").alias("n_control"), ((c("y1") - c("y0")) - (c("c1") - c("c0"))).alias("effect"))


def by_exposure(effects: DataFrame) -> DataFrame:
    """Mean effect by years since treatment, cohorts weighed by their rows in that year."""
    return effects.groupBy("since").agg((F.sum(c("effect") * c("n_treated")) / F.sum("n_treated")).alias("effect"), F.sum("n_treated").alias("n"))


def by_cohort(effects: DataFrame) -> DataFrame:
    """Mean effect of each cohort over its years of treatment, and the overall effect in every row."""
    g = effects.where("since >= 0").groupBy("cohort").agg(F.avg("effect").alias("effect"), F.sum("n_treated").alias("n"))
    return g.crossJoin(F.broadcast(g.agg((F.sum(c("effect") * c("n")) / F.sum("n")).alias("overall"))))
