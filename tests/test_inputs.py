"""Inputs of the registered queries."""

from pyspark.sql import functions as F

from keysift.catalog import inputs

PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
SUPPLIERS = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def test_texts_of_a_small_file_are_read_by_many_tasks(spark, tmp_path):
    """A file of few bytes may hold many rows, each of which is a text to parse."""
    parts = [(i, f"part {i}", "b", "t", i % 50, 1.0) for i in range(400)]
    spark.createDataFrame(parts, PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    suppliers = [(i, f"s{i}", i % 25, 1.0) for i in range(400)]
    spark.createDataFrame(suppliers, SUPPLIERS).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for texts in (inputs.badging(spark, str(tmp_path)), inputs.metadata_documents(spark, str(tmp_path))):
        tasks = [r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 400 and max(tasks) <= 200
