"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable

#: Words are what stands between runs of space and ASCII control white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have (any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def kept_rows(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with a ``_row`` number.

    The number identifies a row even when all its values repeat, and it stays the same in later jobs because
    the written partitions do.
    """
    return reliable(df).withColumn("_row", F.monotonically_increasing_id())


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def settled(c: Column) -> Column:
    """``c``, computed once per row: the row number (0 or more) keeps the optimizer from copying it into lambdas."""
    return F.when(F.monotonically_increasing_id() >= 0, c)
