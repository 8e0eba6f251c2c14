"""Readers and writers of panels, ledgers and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOGUE

c = F.col


def read_csv(spark: SparkSession, path: str, table: str, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with the table's explicit schema, or by header names with a rename map and casts."""
    schema = CATALOGUE[table]
    if not rename:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    d = spark.read.option("header", True).csv(path).withColumnsRenamed(rename)
    return d.select(*[c(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in d.columns])


def read_jdbc(spark: SparkSession, url: str, query: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A SQL source read in ``parts`` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def quick_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over DataFrames passed by name."""
    return spark.sql(sql, **tables)


def history(df: DataFrame, company_id: int | str, start: int, end: int) -> DataFrame:
    """One entity's rows in a year range; both predicates reach the scan."""
    return df.where((c("company_id") == company_id) & c("year").between(start, end))


def append(df: DataFrame, path: str, partition: str = "year") -> None:
    """Bulk insert: rows of a period are gathered by a shuffle on (period, hash) before writing."""
    df.repartition(partition, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(32))).write.mode("append").partitionBy(partition).parquet(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).format(fmt)
    w = w.option("header", True) if fmt == "csv" else w
    (w.partitionBy(partition) if partition else w).save(path)


def export(tables: dict[str, DataFrame], root: str, entities: DataFrame, market: str | None = None) -> None:
    """Every fact table, restricted to one category's entities by a semi join."""
    keep = entities.where(c("market") == market).select("company_id") if market else entities.select("company_id")
    for name, df in tables.items():
        write(df.join(keep, "company_id", "left_semi"), f"{root}/{name}")


def check_tables(df: DataFrame, table: str) -> DataFrame:
    """Missing columns and type differences against the catalogue."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(f.name, f.dataType.simpleString(), have.get(f.name)) for f in CATALOGUE[table] if have.get(f.name) != f.dataType.simpleString()]
    return df.sparkSession.createDataFrame(rows, "field string, expected string, found string")


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once (counts combine on the map side)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
