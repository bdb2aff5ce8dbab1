"""Every registered query beside its SQL on whole tables."""

import hashlib
import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from opslens.plans import sql_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    rows = QUERIES[name](spark, SF_DIR)
    if name not in SQL:
        assert rows.count() >= 0
        return
    assert differences(rows, con, SQL[name]) == ""


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_clipped_texts_deals_out_a_table_of_one_file(spark, tmp_path):
    rows = [(i, f"name{i % 50}" if i % 9 else None) for i in range(200)] * 2 + [(None, "é" * 20)]
    customers = spark.createDataFrame(rows, "c_custkey bigint, c_name string")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() == 1
    found = sql_queries.clipped_texts(spark, str(tmp_path))
    sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == len(rows) and len(sizes) == 4 and max(sizes) < len(rows) / 2
    for r in found.collect():
        name = None if r.c_custkey is not None and r.c_custkey % 9 == 0 else f"name{r.c_custkey % 50}" if r.c_custkey else "é" * 20
        text = name and (name + "é𝒳") * 4_000
        assert r.url == (name and hashlib.md5(text[:2_000].encode()).hexdigest())
