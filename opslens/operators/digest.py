"""Ranked digests of log lines: exceptions, repeated lines, volume per minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.loglines import (
    MINUTE_LABEL,
    MINUTE_LABEL_ANY,
    MINUTE_START,
    carried_time,
    exception_key,
    exception_of,
    loose_parts,
)
from ..functions.text import collapse_spaces
from ..options import DEFAULTS, Options
from .ordering import carry_time, last_known, last_lines, top_per_group


def _tail(lines: DataFrame, n: int | None) -> DataFrame:
    return lines if n is None else last_lines(lines, n)


def exception_digest(
    lines: DataFrame, scan_lines: int | None = None, opts: Options = DEFAULTS, iso: bool = True
) -> DataFrame:
    """Exceptions grouped per file: first message, count, first and last carried time; top groups.

    ``scan_lines`` looks only at the end of every file (None: at all of it). Lines without a time of
    their own, such as stack traces, take the last time seen above them.
    """
    marked = _tail(lines, scan_lines).select(
        "file",
        "block",
        "seq",
        carried_time("line", iso).alias("line_ts"),
        exception_of("line").alias("exception"),
    )
    # Only exceptions and times move on from here, not the lines.
    wanted = F.col("exception").isNotNull()
    if scan_lines is None:
        found = carry_time(marked, keep=wanted)
    else:
        # No more than scan_lines rows per file.
        above = (
            Window.partitionBy("file")
            .orderBy("block", "seq")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        found = marked.withColumn("carried", F.last("line_ts", ignorenulls=True).over(above)).where(wanted)
    at = F.struct("block", "seq")
    groups = (
        found.withColumn("key", exception_key(F.col("exception")))
        .groupBy("file", "key")
        .agg(
            F.min_by(
                F.struct(
                    F.col("exception.class").alias("class"),
                    F.col("exception.message").alias("message"),
                    F.col("carried").alias("first_seen"),
                ),
                at,
            ).alias("first"),
            F.count(F.lit(1)).alias("count"),
            last_known("carried", at).alias("last_seen"),
            F.min(at).alias("at"),
        )
    )
    return (
        top_per_group(
            groups, ["file"], [F.desc("count"), F.asc("at")], opts.exception_groups, "rank"
        )
        .select(
            "file",
            "rank",
            F.col("first.class").alias("class"),
            F.col("first.message").alias("message"),
            "count",
            F.col("first.first_seen").alias("first_seen"),
            "last_seen",
        )
    )


def repeated_lines(
    lines: DataFrame, scan_lines: int | None = None, opts: Options = DEFAULTS
) -> DataFrame:
    """Lines that repeat in a file once their time is cut off; first text, count, times; top groups."""
    parts = (
        _tail(lines, scan_lines)
        .select("file", "block", "seq", loose_parts("line").alias("p"))
        .where(F.col("p").isNotNull())
        .select("file", "block", "seq", "p.*", collapse_spaces("p.text").alias("key"))
    )
    at = F.struct("block", "seq")
    groups = (
        # The text travels only where it differs from its key.
        parts.withColumn("text", F.when(F.col("text") != F.col("key"), F.col("text")))
        .groupBy("file", "key")
        .agg(
            F.min_by(
                F.struct("text", "channel", "level", F.coalesce("stamp", F.lit("")).alias("stamp")), at
            ).alias("first"),
            F.count(F.lit(1)).alias("count"),
            last_known("stamp", at).alias("last_stamp"),
            F.min(at).alias("at"),
        )
        .where(F.col("count") > 1)
    )
    return (
        top_per_group(groups, ["file"], [F.desc("count"), F.asc("at")], opts.repeat_groups, "rank")
        .select(
            "file",
            "rank",
            F.coalesce("first.text", "key").alias("message"),
            F.col("first.level").alias("level"),
            F.col("first.channel").alias("channel"),
            "count",
            F.col("first.stamp").alias("first_seen"),
            F.coalesce("last_stamp", F.lit("")).alias("last_seen"),
        )
    )


def throughput_labels(
    lines: DataFrame, scan_lines: int | None = None, opts: Options = DEFAULTS, iso: bool = True
) -> DataFrame:
    """Lines per HH:MM label of every file, dates folded together: last labels, maximum and total."""
    label = F.regexp_extract("line", MINUTE_LABEL_ANY if iso else MINUTE_LABEL, 1)
    # Non-empty lines without a time count in the total only; they gather under the null label.
    counted = (
        _tail(lines, scan_lines)
        .where(F.length("line") > 0)
        .groupBy("file", F.nullif(label, F.lit("")).alias("label"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    # At most 1,441 rows per file from here on.
    return _last_labels(counted, opts)


def _last_labels(counted: DataFrame, opts: Options) -> DataFrame:
    newest = Window.partitionBy("file").orderBy(F.desc_nulls_last("label"))
    most = opts.throughput_minutes
    shown = F.lit(True) if most is None else F.col("_rank") <= most
    return (
        counted.withColumn("total_lines", F.sum("lines").over(Window.partitionBy("file")))
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("label").isNotNull() & shown)
        .withColumn("max_lines", F.max("lines").over(Window.partitionBy("file")))
        .select("file", "label", "lines", "max_lines", "total_lines")
    )


def throughput_minutes(lines: DataFrame, minutes: int | None = None) -> DataFrame:
    """Lines per file and minute of the date; ``minutes`` keeps that many newest ones per file."""
    start = F.nullif(F.regexp_extract("line", MINUTE_START, 1), F.lit(""))
    counted = (
        lines.select("file", start.try_cast("timestamp").alias("minute"))
        .where(F.col("minute").isNotNull())
        .groupBy("file", "minute")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    return counted if minutes is None else top_per_group(counted, ["file"], [F.desc("minute")], minutes)
