import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        sizes.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] == sizes[5] > 0.5 * sizes[0]
    assert docs.where(~F.col("lossless")).count() == 0
    again = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()}
    assert again == {r.doc_id for r in docs.select("doc_id").collect()}


def test_rows_come_in_the_order_of_the_mix(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        got = [r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("doc_id").isin(got))
    assert got == [r.doc_id for r in mixing.mix(kept).orderBy("position").collect()]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", None, "s", 0), (None, "words " * 300, "en", "s", 9)]])
def test_stages_with_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() <= len(rows)
