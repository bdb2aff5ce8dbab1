"""Endpoints that differ after the stored length of a path stay apart."""

from datetime import datetime

from opslens.operators.endpoints import endpoint_stats


def test_long_paths_do_not_merge(spark):
    start = "/a" * 300
    rows = [("http", f"{start}/{end}", 200, float(i), i, datetime(2026, 1, 1, 0, 0, i)) for i, end in enumerate(("x", "y", "y"))]
    samples = spark.createDataFrame(rows, "type string, path string, status int, ms double, seq bigint, ts timestamp")
    found = endpoint_stats(samples).collect()
    assert sorted(r.requests for r in found) == [1, 2]
    assert {r.path for r in found} == {start[:500]}
