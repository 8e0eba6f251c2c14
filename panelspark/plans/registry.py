"""Query catalogue: each entry pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import rnd
from ..sources.derive import oracle_views

CATALOGUE: dict[str, "Query"] = {}


@dataclass
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, covers: str, keys: str, vals: str = "", sql: str | None = None, digits: int = 6):
    """Register a plan.

    ``keys`` are passed through, ``vals`` are cast to double and rounded the
    same way on both sides.  ``covers`` lists the inventory ids served.
    """
    ks, vs = keys.split(), vals.split()

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*ks, *[rnd(F.col(v), digits).alias(v) for v in vs])

        text = None
        if sql is not None:
            m = f"1e{digits}"
            outs = ks + [f"floor(cast({v} as double)*{m}+0.5)/{m} AS {v}" for v in vs]
            text = f"WITH {oracle_views(sql)} q AS ({sql}) SELECT {', '.join(outs)} FROM q"
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(name, covers, run, text)
        return fn

    return deco
