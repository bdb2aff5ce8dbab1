"""Grouped log records: grouping, merging batches, statistics and retention."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import empty_to_null, message_key
from ..options import DEFAULTS, Options

LATEST = ("context", "extra", "url", "ip")


def with_message_key(records: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Add the grouping key; null with grouping off."""
    key = message_key("channel", "level", "message", opts.key_length)
    return records.withColumn("message_key", key if opts.grouping else F.lit(None).cast("string"))


def as_single_rows(records: DataFrame) -> DataFrame:
    """Records in the shape of groups, one row each: what is stored with grouping off."""
    return records.select(
        F.lit(None).cast("string").alias("message_key"),
        "channel",
        "level",
        "level_name",
        "message",
        *[empty_to_null(c).alias(c) for c in ("context", "extra")],
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
        F.lit(1).cast("bigint").alias("occurrences"),
        *[empty_to_null(c).alias(c) for c in ("url", "ip")],
    )


def group_records(
    records: DataFrame, opts: Options = DEFAULTS, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per message key: count, first and last time, and the details of the latest record.

    Of several records with the latest time the earliest arrival (block, seq) wins; the level name is
    the first arrival's. ``by`` groups under further columns too, such as a batch number.
    """
    if not opts.grouping:
        return as_single_rows(records)
    arrival = F.struct("block", "seq")
    newest_first = F.struct(F.negative(F.unix_micros("ts")), F.col("block"), F.col("seq"))
    return (
        with_message_key(records, opts)
        .groupBy(*by, "message_key", "channel", "level")
        .agg(
            F.min_by("level_name", arrival).alias("level_name"),
            F.min_by(
                F.struct("message", *[empty_to_null(c).alias(c) for c in LATEST]), newest_first
            ).alias("latest"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("occurrences"),
        )
        .select(
            *by,
            "message_key",
            "channel",
            "level",
            "level_name",
            "latest.message",
            "latest.context",
            "latest.extra",
            "first_seen",
            "last_seen",
            "occurrences",
            "latest.url",
            "latest.ip",
        )
    )


def merge_groups(groups: DataFrame, by: str = "time") -> DataFrame:
    """Fold grouped batches, numbered by ``version``, into one row per message key.

    ``by="arrival"`` is last-write-wins: the first batch fixes message, level and first time, the
    last batch sets last time, context, extra, url and ip, even to null. ``by="time"`` takes the
    earliest first time and the details, message included, of the latest event time, so the result
    does not depend on how records were cut into batches. Rows without a key are never merged. The
    result carries the highest version folded into each row, so it can be merged again.
    """
    if by == "time":
        first, last = F.struct("first_seen", "version"), F.struct("last_seen", "version")
    elif by == "arrival":
        first = last = F.struct("version")
    else:
        raise ValueError("by is 'time' or 'arrival'")
    details = F.struct("last_seen", "message", *LATEST)
    merged = (
        groups.where(F.col("message_key").isNotNull())
        .groupBy("message_key")
        .agg(
            F.min_by(F.struct("channel", "level", "level_name", "message", "first_seen"), first).alias("f"),
            F.max_by(details, last).alias("l"),
            F.sum("occurrences").alias("occurrences"),
            F.max("version").alias("version"),
        )
        .select(
            "message_key",
            "f.channel",
            "f.level",
            "f.level_name",
            "l.message" if by == "time" else "f.message",
            "l.context",
            "l.extra",
            "f.first_seen",
            "l.last_seen",
            "occurrences",
            "l.url",
            "l.ip",
            "version",
        )
    )
    single = groups.where(F.col("message_key").isNull()).select(*merged.columns)
    return merged.unionByName(single)


def table_stats(groups: DataFrame, size_bytes: int | None = None) -> DataFrame:
    """Row count, grouped rows, total occurrences and, where known, the stored size."""
    return groups.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(size_bytes).cast("bigint").alias("table_size_bytes"),
        F.count("message_key").alias("grouped_rows"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("total_occurrences"),
    )


def channels(records: DataFrame) -> DataFrame:
    return records.select("channel").distinct().orderBy("channel")


def older_than(now: Column, hours: int, time: str = "last_seen") -> Column:
    return F.col(time) < now - F.make_interval(hours=F.lit(max(1, hours)))


def expire_by_age(
    records: DataFrame, now: Column, hours: int = DEFAULTS.retention_hours, time: str = "last_seen"
) -> DataFrame:
    """Rows young enough to keep; a partition filter on the date goes first where there is one."""
    return records.where(~older_than(now, hours, time))


def count_expired(
    records: DataFrame, now: Column, hours: int = DEFAULTS.retention_hours, time: str = "last_seen"
) -> DataFrame:
    return records.agg(F.count_if(older_than(now, hours, time)).alias("expired"))


# A cut takes this multiple of the excess, and at most this share of all rows.
CUT_FACTOR, CUT_SHARE = 1.2, 0.9


@dataclass(frozen=True)
class SizeCut:
    """How many of the oldest rows a size limit removes."""

    total_rows: int
    rows_to_delete: int

    @classmethod
    def plan(cls, size_bytes: int, total_rows: int, limit_bytes: int) -> "SizeCut":
        """Excess over the limit plus 20 %, in rows of average size, at most 90 % of all rows."""
        if size_bytes <= limit_bytes or total_rows <= 0:
            return cls(total_rows, 0)
        row_bytes = math.ceil(size_bytes / total_rows)
        wanted = math.ceil((size_bytes - limit_bytes) * CUT_FACTOR / row_bytes)
        return cls(total_rows, max(0, min(wanted, int(total_rows * CUT_SHARE))))


def nth_smallest(df: DataFrame, column: str, n: int, buckets: int = 65_536) -> int:
    """The n-th smallest value of a unique integer column.

    Counts per value range narrow the range down by ``buckets`` per pass, so only range counts are
    ever brought together, however large ``n`` is.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    before = 0
    while low < high:
        width = max(1, -(-(high - low + 1) // buckets))
        counts = (
            df.where(F.col(column).between(low, high))
            .groupBy(F.floor((F.col(column) - low) / width).cast("bigint").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        running = F.sum("rows").over(Window.orderBy("bucket"))
        hit = (
            counts.withColumn("upto", running)
            .where(F.col("upto") >= n - before)
            .orderBy("bucket")
            .limit(1)
            .first()
        )
        before += hit["upto"] - hit["rows"]
        low, high = low + hit["bucket"] * width, min(high, low + (hit["bucket"] + 1) * width - 1)
    return low


def expire_by_size(
    records: DataFrame, size_bytes: int, opts: Options = DEFAULTS, id: str = "id",
    limit_bytes: int | None = None,
) -> DataFrame:
    """Rows left after the oldest ids are dropped to bring the table below its size limit."""
    limit = opts.max_table_mb * 1024 * 1024 if limit_bytes is None else limit_bytes
    if size_bytes <= limit:
        return records
    cut = SizeCut.plan(size_bytes, records.count(), limit)
    if cut.rows_to_delete <= 0:
        return records
    return records.where(F.col(id) > nth_smallest(records, id, cut.rows_to_delete))
