"""The corpus pipeline's stages on the small table, each written and read again."""

import re

import corpus_pipeline
from panelspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == columns
        if k < 2:
            assert after.count() < before.count() and after.subtract(before).count() == 0
        if name == "secret_scans":
            assert after.count() == before.count()
            assert not any(re.search("[0-9a-f]{24}", r.text) for r in after.collect())
        before = after
    assert before.select("doc_id").distinct().subtract(docs.select("doc_id")).count() == 0
    assert before.groupBy("group", "bin").sum("n_words").agg({"sum(n_words)": "max"}).first()[0] <= 2048


def test_one_query_an_operator():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
