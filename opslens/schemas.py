"""Schemas of the record types and tables. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

STRING, INT, LONG, DOUBLE = StringType(), IntegerType(), LongType(), DoubleType()
BOOL, TIME = BooleanType(), TimestampType()


def struct(**fields: DataType) -> StructType:
    schema = StructType()
    for name, kind in fields.items():
        schema.add(name, kind)
    return schema


LOG_LINE = struct(file=STRING, block=LONG, seq=LONG, line=STRING)

LOG_FILE = struct(file_name=STRING, size_bytes=LONG, modified=TIME, path=STRING)

LOG_RECORD = struct(
    file=STRING, block=LONG, seq=LONG, ts=TIME, channel=STRING, level=INT, level_name=STRING,
    message=STRING, context=STRING, extra=STRING, url=STRING, ip=STRING,
)

LOG_GROUP = struct(
    message_key=STRING, channel=STRING, level=INT, level_name=STRING, message=STRING,
    context=STRING, extra=STRING, first_seen=TIME, last_seen=TIME, occurrences=LONG,
    url=STRING, ip=STRING,
)

FILE_SPIKE = struct(file=STRING, errors=LONG, spike=BOOL)

QUERY_SAMPLE = struct(
    request_id=STRING, seq=LONG, ts=TIME, url=STRING, sql=STRING, params_json=STRING, ms=DOUBLE,
    caller=STRING,
)

# A sample stream marks the end of a request in its last row.
STREAMED_SAMPLE = struct(**{f.name: f.dataType for f in QUERY_SAMPLE.fields}, ended=BOOL)

ANALYSIS = struct(
    executions=LONG, unique_params=LONG, same_params_max=LONG, all_identical=BOOL,
    avg_ms=DOUBLE, min_ms=DOUBLE, max_ms=DOUBLE, total_ms=DOUBLE,
)

SQL_ISSUE = struct(
    template=STRING, is_n1=BOOL, is_slow=BOOL, executions=LONG, worst_n1=LONG,
    worst_slow_ms=DOUBLE, caller=STRING, params_json=STRING, url=STRING, reason=STRING,
    suggestion=STRING, analysis=ANALYSIS, last_seen=TIME,
)

# Where an issue was seen, and who caused it there.
SEEN_AT = struct(at=TIME, request_id=STRING)
SEEN_BY = struct(at=SEEN_AT, caller=STRING, params_json=STRING, url=STRING)

ISSUE_DELTA = struct(
    template=STRING, is_n1=BOOL, is_slow=BOOL, executions=LONG, worst_n1=LONG,
    worst_slow_ms=DOUBLE, reason=STRING, suggestion=STRING, analysis=ANALYSIS, last_seen=TIME,
    at=SEEN_AT, slow_by=SEEN_BY, n1_by=SEEN_BY,
)

TIMING_SAMPLE = struct(path=STRING, type=STRING, ms=DOUBLE, status=INT, ts=TIME, seq=LONG)

ENDPOINT_STAT = struct(
    path=STRING, type=STRING, ema_ms=DOUBLE, min_ms=DOUBLE, max_ms=DOUBLE, requests=LONG,
    last_seen=TIME, last_status=INT,
)

ENDPOINT_DELTA = struct(
    path=STRING, type=STRING, ema_part=DOUBLE, first_ms=DOUBLE, min_ms=DOUBLE, max_ms=DOUBLE,
    requests=LONG, last_seen=TIME, last_status=INT,
)

HOST_SNAPSHOT = struct(
    instance_id=STRING, hostname=STRING, ip=STRING, collected_at=TIME, uptime_s=DOUBLE,
    load=struct(m1=DOUBLE, m5=DOUBLE, m15=DOUBLE),
    mem=struct(total=LONG, free=LONG, available=LONG),
    cpu=struct(cores=INT, total=LONG, idle=LONG),
    disk=struct(total=LONG, free=LONG),
    procs=ArrayType(
        struct(pid=STRING, user=STRING, ticks=LONG, start_ticks=LONG, rss_kb=LONG, command=STRING)
    ),
)

PLAN_DOC = struct(template=STRING, plan_json=STRING)


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill columns that rows written before a schema addition lack or hold as null."""
    for name, default in defaults.items():
        value = F.coalesce(F.col(name), default) if name in df.columns else default
        df = df.withColumn(name, value)
    return df


def upgrade_log_groups(df: DataFrame, *others: str) -> DataFrame:
    """Rows stored before grouping existed count once and were first seen when last seen. ``others`` are
    further columns to keep."""
    df = fill_defaults(df, {"occurrences": F.lit(1).cast(LONG), "first_seen": F.col("last_seen")})
    if "message_key" not in df.columns:
        df = df.withColumn("message_key", F.lit(None).cast(STRING))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_GROUP.fields], *others)
