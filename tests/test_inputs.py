"""Derived inputs come in tasks enough, whatever the files of the tables they are made of."""

import pytest
from pyspark.sql import functions as F

from docloom.plans import inputs


@pytest.mark.parametrize("name, key", [("markup", "page_id"), ("texts", "doc_id"), ("markdown", "doc_id"), ("prose_items", "page_no"), ("pixels", "img_id"), ("uploads", "file_id")])
def test_rows_of_one_small_file_are_dealt_out(spark, sf_dir, name, key):
    rows = inputs.load(spark, sf_dir, name).groupBy(F.spark_partition_id()).agg(F.count_distinct(key).alias("n")).collect()
    total = sum(r["n"] for r in rows)
    assert len(rows) >= min(total, 16) / 2
    assert max(r["n"] for r in rows) <= max(8, total / 4)


def test_tasks_follow_the_size_of_a_table(spark, tmp_path):
    spark.range(400_000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert inputs.dealt(table, 1 << 30).rdd.getNumPartitions() == inputs.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    parts = inputs.dealt(table, 100_000).rdd.glom().map(len).collect()
    assert len(parts) > 60 and max(parts) < 2 * 400_000 / len(parts)
