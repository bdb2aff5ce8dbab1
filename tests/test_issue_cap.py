"""A request with some thousand samples loses none of them in the issue queries."""

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from compare import connect, differences

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()
SAMPLES = 3_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Order 1 holds SAMPLES items; its second template, slowest item and last date come after the 500th."""
    path = str(tmp_path_factory.mktemp("requests"))
    number = F.col("id").cast("int")
    late = number > 600
    items = spark.range(1, SAMPLES + 1).select(
        F.lit(1).cast("bigint").alias("l_orderkey"), number.alias("l_linenumber"), (number % 7).cast("bigint").alias("l_partkey"),
        (number % 5).cast("bigint").alias("l_suppkey"), (number % 90 + F.when(late, 9).otherwise(0)).cast("double").alias("l_quantity"),
        (number * 1.25).cast("double").alias("l_extendedprice"), F.when(late, "N").otherwise("R").alias("l_returnflag"),
        F.when(late, "O").otherwise("F").alias("l_linestatus"), F.date_add(F.lit("2020-01-01").cast("date"), number).cast("timestamp_ntz").alias("l_shipdate"),
    )
    few = items.where("l_linenumber <= 4").withColumn("l_orderkey", F.lit(2).cast("bigint"))
    items.unionByName(few).coalesce(1).write.parquet(f"{path}/parts")
    (written,) = glob(f"{path}/parts/*.parquet")
    os.link(written, f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize(
    "name",
    ["sql_issues", "sql_advice", "issue_briefs", "issue_merge", "issue_attribution", "issue_view", "explain_picks", "explain_first"],
)
def test_no_sample_is_lost(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == ""


def test_all_executions_count(spark, folder):
    issues = QUERIES["sql_issues"](spark, folder).where("request_id = '1'")
    assert issues.agg(F.sum("executions"), F.count("*")).first() == (SAMPLES, 2)
