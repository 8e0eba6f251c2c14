"""Accelerated failure time models: exponential, Weibull, log-normal, log-logistic and gamma.

``log T = x b + error``.  A task sums the log likelihood, its gradient and its second derivatives over its rows, for all
families at once; the driver takes Newton steps on the few parameters of each.  The shape parameter is the log of the
scale of ``log T``, or the log of the shape of the gamma distribution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finish
from ..functions.cols import total

c = F.col
T, E = "duration", "event"
FAMILIES = ("exponential", "weibull", "lognormal", "loglogistic", "gamma")


def digamma(a: float) -> float:
    shift = 0.0
    while a < 12:
        shift, a = shift - 1 / a, a + 1
    r = 1 / (a * a)
    return shift + math.log(a) - 0.5 / a - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(a: float) -> float:
    shift = 0.0
    while a < 12:
        shift, a = shift + 1 / (a * a), a + 1
    r = 1 / (a * a)
    return shift + 1 / a + r / 2 + r / a * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def log_upper_gamma(a: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln Q(a, e^z), regularized, and its first two derivatives in a.

    Below a + 1 by the series of the lower function, each term with its derivatives; above by Gauss-Laguerre
    quadrature of (u + s)^(a - 1) e^-s, whose derivatives are the same sums with powers of ln(u + s).
    """
    u = np.exp(np.minimum(z, 700.0))
    q, q1, q2 = np.empty_like(z), np.empty_like(z), np.empty_like(z)
    low = u < a + 1
    if low.any():
        x, lz = u[low], z[low]
        t = np.full(len(x), 1 / a)
        t1, t2 = -t / a, 2 * t / (a * a)
        s, s1, s2, n = t.copy(), t1.copy(), t2.copy(), a
        while np.abs(t2).max() > 1e-17 * np.abs(s2).max() or np.any(t > 1e-17 * s):
            n += 1
            r = x / n
            t2 = t2 * r - 2 * t1 * r / n + 2 * t * r / (n * n)
            t1 = t1 * r - t * r / n
            t = t * r
            s, s1, s2 = s + t, s1 + t1, s2 + t2
        p = np.exp(a * lz - x - math.lgamma(a) + np.log(s))
        d1 = lz - digamma(a) + s1 / s
        d2 = s2 / s - (s1 / s) ** 2 - trigamma(a)
        rest = np.maximum(1 - p, 1e-300)
        q[low], q1[low] = np.log(rest), -p * d1 / rest
        q2[low] = -p * (d2 + d1 * d1) / rest - q1[low] ** 2
    high = ~low
    if high.any():
        nodes, weights = np.polynomial.laguerre.laggauss(48)
        x = u[high][:, None]
        lx = np.log(x + nodes)
        top = (a - 1) * np.log(x) if a > 1 else 0 * x  # keeps the powers in range
        f = weights * np.exp((a - 1) * lx - top)
        s = f.sum(axis=1)
        m1, m2 = (f * lx).sum(axis=1) / s, (f * lx * lx).sum(axis=1) / s
        q[high] = np.log(s) + top[:, 0] - u[high] - math.lgamma(a)
        q1[high], q2[high] = m1 - digamma(a), m2 - m1 * m1 - trigamma(a)
    return q, q1, q2


def log_normal_tail(z: np.ndarray) -> np.ndarray:
    """ln of the upper normal tail, by the incomplete gamma function of shape one half."""
    far = log_upper_gamma(0.5, np.log(np.maximum(z * z / 2, 1e-300)))[0] - math.log(2)
    return np.where(z > 0, far, np.log1p(-np.exp(np.minimum(far, -math.log(2)))))


def _standard(dist: str, z: np.ndarray, ev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log density (log survival of the censored) of the standardized log time and two derivatives in z."""
    if dist in ("weibull", "exponential"):
        ez = np.exp(np.clip(z, -700, 60))
        return ev * z - ez, ev - ez, -ez
    if dist == "lognormal":
        tail = log_normal_tail(z)
        m = np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - tail)
        done = ev > 0
        return (np.where(done, -z * z / 2 - 0.5 * math.log(2 * math.pi), tail), np.where(done, -z, -m), np.where(done, -1.0, -m * (m - z)))
    p = 1 / (1 + np.exp(-z))
    return ev * z - (1 + ev) * np.logaddexp(0, z), ev - (1 + ev) * p, -(1 + ev) * p * (1 - p)


def contributions(dist: str, y: np.ndarray, ev: np.ndarray, eta: np.ndarray, shape: float):
    """Log likelihood of each row in log time, with derivatives in eta and in the shape parameter (first, second, mixed)."""
    if dist == "gamma":
        a, z = math.exp(shape), y - eta
        u = np.exp(np.minimum(z, 700.0))
        q, q1, q2 = log_upper_gamma(a, z)
        done = ev > 0
        f = a * z - u - math.lgamma(a)
        h = np.exp(np.minimum(f - q, 700.0))
        psi = digamma(a)
        da = np.where(done, z - psi, q1)
        daa = np.where(done, -trigamma(a), q2)
        dea = np.where(done, -1.0, h * (z - psi - q1))
        return (np.where(done, f, q), np.where(done, u - a, h), a * da, np.where(done, -u, -h * (a - u + h)), a * dea, a * da + a * a * daa)
    s = 1.0 if dist == "exponential" else math.exp(shape)
    z = (y - eta) / s
    g, g1, g2 = _standard(dist, z, ev)
    return g - math.log(s) * ev, -g1 / s, -ev - z * g1, g2 / (s * s), (g1 + z * g2) / s, z * g1 + z * z * g2


@dataclass
class Fit:
    dist: str
    names: list[str]
    intercept: float
    coef: np.ndarray
    shape: float
    loglik: float
    n: int
    converged: bool
    iterations: int
    cov: np.ndarray  # of intercept, coefficients and the shape parameter (none for the exponential family)

    @property
    def scale(self) -> float:
        """Scale of log T; of the gamma family its shape."""
        return math.exp(self.shape)

    @property
    def k(self) -> int:
        return 1 + len(self.names) + (self.dist != "exponential")

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.loglik

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2 * self.loglik

    def eta(self) -> Column:
        return total([F.lit(self.intercept), *[c(x) * float(b) for x, b in zip(self.names, self.coef)]])

    def median_factor(self) -> float:
        """The median of T is this times exp(eta)."""
        if self.dist in ("exponential", "weibull"):
            return math.log(2.0) ** self.scale
        if self.dist != "gamma":
            return 1.0
        low, high = -60.0, 60.0  # bisection on ln u
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if log_upper_gamma(self.scale, np.array([mid]))[0][0] > math.log(0.5) else (low, mid)
        return math.exp(low)


def fit_all(df: DataFrame, dists: list[str], xs: list[str] | None = None, max_iter: int = 100, tol: float = 1e-13) -> list[Fit]:
    """Maximum likelihood of every family; one pass over the rows serves a step of all of them.

    Rows with a positive duration and all covariates count.  ``converged`` is false where ``max_iter`` steps were not
    enough: the expected gain of a further step, relative to the rows, is then above ``tol``.  Without such rows there
    is nothing to fit and a ValueError is raised; without any event a likelihood has no maximum, and so does that.
    """
    xs = list(xs or [])
    d = df.where(c(T) > 0).select(c(T).cast("double").alias("t"), c(E).cast("double").alias("e"), *[c(x).cast("double").alias(x) for x in xs]).dropna()
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    st = d.agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("events"), F.avg(F.ln("t")).alias("m"), F.stddev_pop(F.ln("t")).alias("s"), F.sum(c("e") * F.ln("t")).alias("elt"), F.sum("t").alias("t"),
               *[a for i, x in enumerate(xs) for a in (F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]).first()
    if not st["n"] or not st["events"]:
        d.unpersist()
        raise ValueError("a parametric fit needs rows with a positive duration, and an event")
    mu, sg = (np.array([float(st[f"{a}{i}"]) or (0.0 if a == "m" else 1.0) for i in range(len(xs))]) for a in "ms")
    p = 1 + len(xs)
    size = {f: p + (f != "exponential") for f in dists}
    start = math.log(st["t"] / st["events"])
    theta = {f: np.r_[st["m"] if f in ("lognormal", "loglogistic") else start, np.zeros(p - 1), [math.log(max(st["s"], 1e-2)) if f in ("lognormal", "loglogistic") else 0.0] * (size[f] - p)] for f in dists}

    def sums(at: dict[str, np.ndarray]) -> dict[str, tuple]:
        """Log likelihood, gradient and second derivatives of each family at its parameters."""
        at = {f: (v, size[f]) for f, v in at.items()}
        n_out = 1 + (p + 1) + (p + 1) ** 2

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = {f: np.zeros(n_out) for f in at}
            for b in batches:
                x = np.column_stack([np.ones(len(b)), *[(b[v].to_numpy() - m) / s for v, m, s in zip(xs, mu, sg)]])
                y, ev = np.log(b["t"].to_numpy()), b["e"].to_numpy()
                for f, (v, _) in at.items():
                    l, e1, s1, e2, es, s2 = contributions(f, y, ev, x @ v[:p], v[p] if len(v) > p else 0.0)
                    h = np.zeros((p + 1, p + 1))
                    h[:p, :p], h[p, :p], h[p, p] = x.T @ (x * e2[:, None]), x.T @ es, s2.sum()
                    h[:p, p] = h[p, :p]
                    out[f] += np.r_[l.sum(), x.T @ e1, s1.sum(), h.ravel()]
            yield pd.DataFrame({"f": list(out), "v": list(out.values())})

        rows = d.mapInPandas(part, "f string, v array<double>").select("f", F.posexplode("v").alias("i", "v")).groupBy("f", "i").agg(F.sum("v").alias("v")).collect()
        got = {f: np.zeros(n_out) for f in at}
        for r in rows:
            got[r["f"]][r["i"]] = r["v"]
        return {f: (v[0], v[1:1 + k], v[p + 2:].reshape(p + 1, p + 1)[:k, :k]) for f, v in got.items() for k in [at[f][1]]}

    now = sums(theta)
    steps, scale, done, tries = {}, {f: 1.0 for f in dists}, {}, {f: 0 for f in dists}
    for turn in range(1, max_iter + 1):
        for f in dists:
            if f in done or f in steps:
                continue
            _, g, h = now[f]
            w, q = np.linalg.eigh(-h)  # a step uphill also where the likelihood is not concave
            steps[f], scale[f] = q @ ((q.T @ g) / np.maximum(np.abs(w), 1e-8 * np.abs(w).max() + 1e-300)), 1.0
            longest = np.abs(steps[f]).max()
            steps[f] *= min(1.0, 2.0 / longest) if longest > 0 else 1.0
            if float(g @ steps[f]) < tol * st["n"]:
                done[f] = turn - 1
        open_ = [f for f in dists if f not in done]
        if not open_:
            break
        new = sums({f: theta[f] + scale[f] * steps[f] for f in open_})
        for f in open_:
            if np.isfinite(new[f][0]) and new[f][0] >= now[f][0] - 1e-9 * abs(now[f][0]):
                theta[f], now[f] = theta[f] + scale[f] * steps.pop(f), new[f]
            else:
                scale[f] /= 2
    d.unpersist()
    # from standardized covariates back to given ones
    back = np.eye(p + 1)
    for i in range(p - 1):
        back[0, 1 + i], back[1 + i, 1 + i] = -mu[i] / sg[i], 1 / sg[i]
    out = []
    for f in dists:
        m = back[:size[f], :size[f]]
        b = m @ theta[f]
        cov = m @ np.linalg.pinv(-now[f][2]) @ m.T
        out.append(Fit(f, xs, float(b[0]), b[1:p], float(theta[f][p]) if size[f] > p else 0.0, float(now[f][0] - st["elt"]), st["n"], f in done, done.get(f, max_iter), cov))
    return out


def comparison(spark, fits: list[Fit]) -> DataFrame:
    """A row for each family, by AIC; ranks by AIC and BIC (1 is best)."""
    by = {k: {id(f): i + 1 for i, f in enumerate(sorted(fits, key=lambda f: getattr(f, k)))} for k in ("aic", "bic")}
    rows = [(f.dist, f.intercept, f.scale, f.loglik, f.aic, f.bic, by["aic"][id(f)], by["bic"][id(f)], f.converged) for f in sorted(fits, key=lambda f: f.aic)]
    return spark.createDataFrame(rows, "dist string, intercept double, scale double, loglik double, aic double, bic double, aic_rank int, bic_rank int, converged boolean")


def coefficients(spark, fits: list[Fit]) -> DataFrame:
    """Terms of each family with standard errors from the second derivatives; ``shape`` is on its log scale."""
    rows = []
    for f in fits:
        names, values = ["intercept", *f.names, "shape"][:f.k], [f.intercept, *map(float, f.coef), f.shape][:f.k]
        for i, (n, v) in enumerate(zip(names, values)):
            se = math.sqrt(max(float(f.cov[i, i]), 0.0))
            rows.append((f.dist, n, v, se, finish.norm_two_sided(v / se) if se else None))
    return spark.createDataFrame(rows, "dist string, term string, coef double, se double, p double")


def best(fits: list[Fit], by: str = "aic") -> Fit:
    return min(fits, key=lambda f: getattr(f, by))


def with_median(df: DataFrame, fit: Fit, name: str = "median") -> DataFrame:
    return df.withColumn(name, F.exp(fit.eta()) * fit.median_factor())


def curves(df: DataFrame, fit: Fit, times: list[float], keep: list[str]) -> DataFrame:
    """Survival and hazard of every row of ``df`` at each time; a row without a covariate has nulls."""
    d = df.select(*keep, fit.eta().alias("_eta"), F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("t"))
    kind = ", ".join([*[f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep], "t double, survival double, hazard double"])
    dist, shape = fit.dist, fit.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y, eta = np.log(b["t"].to_numpy(float)), b["_eta"].to_numpy(float)
            known = np.isfinite(eta)
            tail, dense = (contributions(dist, y[known], np.full(known.sum(), e), eta[known], shape)[0] for e in (0.0, 1.0))
            s, h = np.full(len(b), np.nan), np.full(len(b), np.nan)
            s[known], h[known] = np.exp(tail), np.exp(dense - y[known] - tail)
            yield b[[*keep, "t"]].assign(survival=s, hazard=h)

    out = d.mapInPandas(part, kind)
    return out.select(*keep, "t", *[F.when(~F.isnan(x), c(x)).alias(x) for x in ("survival", "hazard")])
