"""Stepwise selection by sweeps of one cross-product matrix.

Spark sums the centred and scaled cross products of all candidates and the outcome once.  Taking a term into the model
or out of it is a sweep of that small matrix; the rows are not read again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finish import t_two_sided
from .regression import complete

c = F.col


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """Sweep on pivot k: takes term k in; the reverse of ``unsweep``."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / d
    out[k, :], out[:, k], out[k, k] = a[k, :] / d, a[:, k] / d, -1 / d
    return out


def unsweep(a: np.ndarray, k: int) -> np.ndarray:
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / d
    out[k, :], out[:, k], out[k, k] = -a[k, :] / d, -a[:, k] / d, -1 / d
    return out


@dataclass
class Gram:
    """Centred cross products of ``names`` and the outcome (last), scaled to unit variance, with what undoes that."""

    names: list[str]
    a: np.ndarray
    n: int
    mean: np.ndarray
    sd: np.ndarray


def gram(df: DataFrame, y: str, xs: list[str]) -> Gram:
    """Two aggregates over complete rows: means and deviations, then the cross products."""
    d = complete(df, [y, *xs]).select(*[c(x).cast("double").alias(f"v{i}") for i, x in enumerate([*xs, y])])
    k = len(xs) + 1
    m = d.agg(F.count(F.lit(1)).alias("n"), *[f(f"v{i}").alias(f"{p}{i}") for i in range(k) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not m["n"]:
        raise ValueError("no complete rows to select terms from")
    mean, sd = (np.array([float(m[f"{p}{i}"]) for i in range(k)]) for p in "ms")
    sd = np.where(sd > 0, sd, 1.0)
    z = [(c(f"v{i}") - mean[i]) / sd[i] for i in range(k)]
    r = d.agg(*[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return Gram(list(xs), np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), m["n"], mean, sd)


def criterion(n: int, rss: float, terms: int, kind: str) -> float:
    """BIC or AIC of a linear model with an intercept and ``terms`` terms, but for a constant."""
    return n * math.log(max(rss, 1e-300) / n) + (terms + 1) * (math.log(n) if kind == "bic" else 2.0)


def stepwise(g: Gram, kind: str = "bic", direction: str = "both", tolerance: float = 1e-9) -> tuple[list[tuple], list[int], np.ndarray]:
    """The path, the terms at its end and the swept matrix.

    Every step takes in or out the one term that lowers the criterion most, and it ends when none does.  ``direction``:
    ``forward`` (from no term, none leaves), ``backward`` (from all, none enters) or ``both`` (from none).  A term that
    the others explain but for ``tolerance`` of its variance does not enter.  Path rows: step, action, term, residual
    sum of squares and criterion, in units of the outcome.
    """
    a, y, inside = g.a.copy(), len(g.names), []
    scale = float(g.sd[y] ** 2)
    if direction == "backward":
        for j in range(y):
            if a[j, j] > tolerance * g.n:
                a, inside = sweep(a, j), [*inside, j]
    now = criterion(g.n, a[y, y] * scale, len(inside), kind)
    path = [(0, "start", None, float(a[y, y] * scale), now)]
    while True:
        moves = []
        for j in range(y):
            if j in inside and direction != "forward":
                moves.append((criterion(g.n, (a[y, y] - a[j, y] ** 2 / a[j, j]) * scale, len(inside) - 1, kind), "out", j))
            elif j not in inside and direction != "backward" and a[j, j] > tolerance * g.n:
                moves.append((criterion(g.n, (a[y, y] - a[j, y] ** 2 / a[j, j]) * scale, len(inside) + 1, kind), "in", j))
        if not moves or (best := min(moves, key=lambda m: (m[0], m[2])))[0] >= now - 1e-10 * (abs(now) + 1):
            return path, sorted(inside), a
        now, action, j = best
        a = sweep(a, j) if action == "in" else unsweep(a, j)
        inside = [*inside, j] if action == "in" else [i for i in inside if i != j]
        path.append((len(path), action, g.names[j], float(a[y, y] * scale), now))


def path_table(spark, path: list[tuple], kind: str = "bic") -> DataFrame:
    return spark.createDataFrame(path, f"step int, action string, term string, rss double, {kind} double")


def model_table(spark, g: Gram, inside: list[int], a: np.ndarray) -> DataFrame:
    """Coefficients of the selected model in given units, with errors, from the swept matrix."""
    y = len(g.names)
    dof = g.n - len(inside) - 1
    s2 = max(float(a[y, y]), 0.0) / dof if dof > 0 else float("nan")
    coef = {j: float(a[j, y] * g.sd[y] / g.sd[j]) for j in inside}
    rows = [("intercept", float(g.mean[y] - sum(b * g.mean[j] for j, b in coef.items())), None, None, None)]
    for j in inside:
        se = float(math.sqrt(-a[j, j] * s2) * g.sd[y] / g.sd[j])
        t = coef[j] / se if se else None
        rows.append((g.names[j], coef[j], se, t, t_two_sided(t, dof) if t is not None else None))
    return spark.createDataFrame(rows, "term string, coef double, se double, t double, p double")


def selected_model(df: DataFrame, y: str, xs: list[str], kind: str = "bic", direction: str = "both") -> DataFrame:
    g = gram(df, y, xs)
    _, inside, a = stepwise(g, kind, direction)
    return model_table(df.sparkSession, g, inside, a)
