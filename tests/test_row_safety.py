"""Ranks joined by value keep every row even when a second evaluation would give other values."""

from pyspark.sql import functions as F

from panelspark.functions.ranks import with_ranks
from panelspark.operators.graph import components
from panelspark.operators.market import position_stability


def test_ranks_keep_rows_of_a_changing_input(spark):
    df = spark.range(0, 500, 1, 4).select("id", (F.col("id") % 3).alias("g"), F.expr("cast(uuid() as string)").alias("s"))
    df = df.select("id", "g", F.xxhash64("s").cast("double").alias("v"))
    assert with_ranks(df, ["g"], "v").count() == 500


def test_position_stability_keeps_rows(spark):
    df = spark.range(0, 600, 1, 4).select((F.col("id") % 100).alias("company_id"), F.lit("m").alias("market"), F.rand().alias("share_change"), F.rand().alias("profit_change"))
    assert position_stability(df).count() == 100


def test_a_long_chain_is_one_component(spark):
    chain = spark.range(0, 130).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    got = components(chain).collect()
    assert len(got) == 131 and {r.label for r in got} == {0}
