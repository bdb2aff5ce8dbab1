"""Latency statistics per endpoint, command and queue topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clip, full_path_template
from ..options import DEFAULTS, Options
from .ordering import last_known


def tracked(samples: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Samples of tracked types and statuses that are not faster than the slow threshold.

    The status counts for http samples that have one; no tracked status at all means every status.
    """
    if opts.tracked_statuses:
        checked = (F.col("type") == "http") & F.col("status").isNotNull()
        samples = samples.where(~checked | F.col("status").isin(*opts.tracked_statuses))
    if not opts.track_cli:
        samples = samples.where(F.col("type") != "cli")
    if not opts.track_mq:
        samples = samples.where(F.col("type") != "mq")
    if opts.slow_endpoint_ms > 0:
        samples = samples.where(F.col("ms") >= opts.slow_endpoint_ms)
    return samples


def with_path_templates(samples: DataFrame) -> DataFrame:
    """http paths reduced to templates; commands and topics keep their names."""
    return samples.withColumn(
        "path", F.when(F.col("type") == "http", full_path_template("path")).otherwise(F.col("path"))
    )


def endpoint_deltas(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of one batch per (path, type), in the shape that merges.

    The average halves its distance to every new sample, so over samples x1..xn it is the sum of
    xi * 2^-(n-i+1), plus x1 * 2^-n for the first sample, which starts it. ``ema_part`` is the sum;
    with the first sample and the count it can be continued by a later batch. Samples are ranked
    within an hour of an endpoint, and the hours' sums are put together by how many samples came
    later, so that a busy endpoint is worked on in parallel. ``by`` keeps further columns apart, such
    as a batch number.
    """
    keys = [*by, "path", "type"]
    hour = F.date_trunc("hour", F.col("ts"))
    part = [*keys, "hour"]
    aged = samples.withColumn("hour", hour).withColumn(
        "age", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("ts"), F.desc("seq")))
    )
    hours = aged.groupBy(*part).agg(
        F.sum(F.col("ms") * F.pow(F.lit(2.0), -F.col("age"))).alias("ema_part"),
        F.max_by("ms", "age").alias("first_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.count(F.lit(1)).alias("requests"),
        F.max("ts").alias("last_seen"),
        F.min_by("status", F.when(F.col("status").isNotNull(), F.col("age"))).alias("last_status"),
    )
    return _folded(hours, keys, "hour")


def _folded(parts: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    """Statistics of consecutive parts, in the order of a column, as those of all together."""
    later = (
        Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    aged = parts.withColumn("_later", F.coalesce(F.sum("requests").over(later), F.lit(0)))
    return aged.groupBy(*keys).agg(
        F.sum(F.col("ema_part") * F.pow(F.lit(2.0), -F.col("_later"))).alias("ema_part"),
        F.min_by("first_ms", order).alias("first_ms"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        F.sum("requests").alias("requests"),
        F.max("last_seen").alias("last_seen"),
        last_known("last_status", F.col(order)).alias("last_status"),
        *more,
    )


def merge_endpoints(deltas: DataFrame) -> DataFrame:
    """Fold batches (numbered by ``version``) into one row per endpoint."""
    # One row per endpoint and batch: the window covers as many rows as there are unfolded batches.
    keys = ["path", "type"]
    return _folded(deltas, keys, "version", F.max("version").alias("version"))


def endpoint_rows(merged: DataFrame) -> DataFrame:
    """The endpoint table as it is read."""
    ema = F.col("ema_part") + F.col("first_ms") * F.pow(F.lit(2.0), -F.col("requests"))
    path = F.when(F.col("type") == "http", clip("path", "path")).otherwise(F.col("path")).alias("path")
    return merged.select(
        path, "type", ema.alias("ema_ms"), "min_ms", "max_ms", "requests", "last_seen", "last_status"
    )


def endpoint_stats(samples: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Statistics over all samples at once: filters, path templates, averages."""
    return endpoint_rows(endpoint_deltas(with_path_templates(tracked(samples, opts))))
