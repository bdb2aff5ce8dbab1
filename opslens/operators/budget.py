"""Debug entries kept within a budget per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordering import first_per_request


def within_budget(entries: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """Entries kept while fewer than ``max_entries`` and less than ``max_bytes`` came before them.

    Needs request_id, seq and bytes. ``truncated`` says whether the request lost an entry.
    """
    # One entry past the limit is enough to see that the limit was hit.
    head = first_per_request(entries, max_entries + 1)
    request = Window.partitionBy("request_id").orderBy("seq")
    before = request.rowsBetween(Window.unboundedPreceding, -1)
    kept = (F.col("_n") <= max_entries) & (F.col("_bytes") < max_bytes)
    return (
        head.withColumns(
            {
                "_n": F.row_number().over(request),
                "_bytes": F.coalesce(F.sum("bytes").over(before), F.lit(0)),
            }
        )
        .withColumn("_kept", kept)
        .withColumn("truncated", F.bool_or(~F.col("_kept")).over(Window.partitionBy("request_id")))
        .where("_kept")
        .drop("_n", "_bytes", "_kept")
    )
