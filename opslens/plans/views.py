"""Logs, samples and snapshots derived from the given tables, in Spark and as SQL.

The tables hold no log files, so their rows are rendered as lines and samples. Both forms cover the
whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SECONDS = "yyyy-MM-dd HH:mm:ss"


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records with their rendered line."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR")
        .when(kind == "signup", "NOTICE")
        .when(kind == "purchase", "WARNING")
        .when(kind == "click", "INFO")
        .otherwise("DEBUG")
    )
    text = F.concat(
        F.lit("user "), F.col("user_id") % 10, F.lit(" raised "), kind,
        F.lit(" code "), F.col("event_id") % 7,
    )
    ts = F.col("ts").cast("timestamp")
    rows = e.select(
        F.concat(kind, F.lit(".log")).alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("event_id").alias("seq"),
        ts.alias("ts"),
        F.concat(F.lit("app"), F.col("user_id") % 3).alias("channel"),
        level.alias("level_name"),
        text.alias("message"),
        F.col("props").alias("context"),
    )
    return rows.withColumn(
        "line",
        F.concat(
            F.lit("["), stamp(F.col("ts"), ISO_MICROS), F.lit("+00:00] "), F.col("channel"), F.lit("."),
            F.col("level_name"), F.lit(": "), F.col("message"), F.lit(" "), F.col("context"),
            F.lit(" {}"),
        ),
    )


LOG_SQL = """
v_log AS (
  SELECT *, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00] ' || channel || '.' || level_name
         || ': ' || message || ' ' || context || ' {}' AS line
  FROM (
    SELECT event_type || '.log' AS file, event_id AS seq, ts, 'app' || (user_id % 3) AS channel,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE'
                WHEN 'purchase' THEN 'WARNING' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END AS level_name,
           CASE event_type WHEN 'error' THEN 400 WHEN 'signup' THEN 250
                WHEN 'purchase' THEN 300 WHEN 'click' THEN 200 ELSE 100 END AS level,
           'user ' || (user_id % 10) || ' raised ' || event_type || ' code ' || (event_id % 7) AS message,
           props AS context
    FROM events)
)"""


def lines(view: DataFrame) -> DataFrame:
    return view.select("file", "block", "seq", "line")


def exception_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines of a service log: two kinds of exception lines, traces and plain lines."""
    e = table(spark, sf_dir, "events")
    at = F.concat(F.lit("["), stamp(F.col("ts").cast("timestamp"), SECONDS), F.lit("] "))
    kind, user, number = F.col("event_type"), F.col("user_id"), F.col("event_id")
    line = (
        F.when(
            kind == "error",
            F.concat(
                at, F.lit('app.ERROR: failed {"exception":"[object] (App\\Data\\MissingException(code: '),
                number % 5, F.lit("): user "), user % 10, F.lit(" has no row ("), number,
                F.lit(") at /srv/app/Load.php:"), number % 40, F.lit(')"} []'),
            ),
        )
        .when(
            kind == "purchase",
            F.concat(
                F.lit("#"), number % 9, F.lit(" [object] (App\\LockError(code: 0): lock "),
                F.lpad(F.hex(number), 8, "a"), F.lit(" lost  by "), user % 4,
                F.lit(" in /srv/app/Lock.php:77)"),
            ),
        )
        .when(
            kind == "click",
            F.concat(
                at, F.lit("web.CRITICAL: handler App\\Ui\\ClickException: bad target line "),
                number % 100, F.lit(" of "), user % 6, F.lit(" {"), number, F.lit("}"),
            ),
        )
        .when(kind == "signup", F.concat(F.lit("    at step "), number % 12))
        .otherwise(F.concat(at, F.lit("web.INFO: served "), user))
    )
    return e.select(
        F.concat(F.lit("svc"), user % 3, F.lit(".log")).alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        number.alias("seq"),
        line.alias("line"),
    )


EXCEPTION_SQL = r"""
v_exc AS (
  SELECT 'svc' || (user_id % 3) || '.log' AS file, event_id AS seq,
    CASE event_type
      WHEN 'error' THEN head || 'app.ERROR: failed {"exception":"[object] (App\Data\MissingException(code: '
        || (event_id % 5) || '): user ' || (user_id % 10) || ' has no row (' || event_id
        || ') at /srv/app/Load.php:' || (event_id % 40) || ')"} []'
      WHEN 'purchase' THEN '#' || (event_id % 9) || ' [object] (App\LockError(code: 0): lock '
        || lpad(hex(event_id), 8, 'a') || ' lost  by ' || (user_id % 4) || ' in /srv/app/Lock.php:77)'
      WHEN 'click' THEN head || 'web.CRITICAL: handler App\Ui\ClickException: bad target line '
        || (event_id % 100) || ' of ' || (user_id % 6) || ' {' || event_id || '}'
      WHEN 'signup' THEN '    at step ' || (event_id % 12)
      ELSE head || 'web.INFO: served ' || user_id END AS line
  FROM (SELECT *, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' AS head FROM events)
)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: one row per text line."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"),
    ).withColumn("seq", F.col("seq").cast("bigint"))


DOCUMENT_SQL = r"""
v_doc_lines AS (
  SELECT doc_id::VARCHAR AS file, i - 1 AS seq, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
)"""


def sample_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as SQL samples: one request per order."""
    item = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    sql = F.concat(
        F.lit("SELECT  * FROM "),
        F.when(F.col("l_linestatus") == "F", "part").otherwise("stock_2"),
        F.lit(" /* by key */ WHERE id = "), part,
        F.lit(" AND price > "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.lit(" AND kind in (1"), F.repeat(F.lit(", 22"), (F.col("l_linenumber") % 4).cast("int")),
        F.lit(") AND name = 'it\\'s "), part, F.lit("' -- line "), F.col("l_linenumber"),
    )
    params = F.concat(
        F.lit('{"p":'), F.col("l_suppkey") % 3, F.lit(',"Api_Token":"t'), part,
        F.lit('","q":"'), F.col("l_returnflag"), F.lit('"}'),
    )
    return item.select(
        F.col("l_orderkey").cast("string").alias("request_id"),
        (
            F.col("l_linenumber") * F.lit(10**13)
            + F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10_000
            + F.col("l_suppkey") % 10_000
        ).alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("/order/"), F.col("l_orderkey")).alias("url"),
        sql.alias("sql"),
        params.alias("params_json"),
        (F.col("l_quantity") / 4).alias("ms"),
        F.col("l_returnflag").alias("caller"),
    )


SAMPLE_SQL = r"""
v_sql AS (
  SELECT l_orderkey::VARCHAR AS request_id, l_linenumber * 10000000000000::BIGINT
      + round(l_extendedprice * 100)::BIGINT * 10000 + l_suppkey % 10000 AS seq,
    l_shipdate AS ts, '/order/' || l_orderkey AS url,
    'SELECT  * FROM ' || CASE WHEN l_linestatus = 'F' THEN 'part' ELSE 'stock_2' END
      || ' /* by key */ WHERE id = ' || l_partkey || ' AND price > '
      || l_extendedprice::DECIMAL(18,2)::VARCHAR || ' AND kind in (1'
      || repeat(', 22', (l_linenumber % 4)::INTEGER) || ') AND name = ''it\''s ' || l_partkey
      || ''' -- line ' || l_linenumber AS sql,
    '{"p":' || (l_suppkey % 3) || ',"Api_Token":"t' || l_partkey || '","q":"' || l_returnflag || '"}'
      AS params_json,
    l_quantity / 4 AS ms, l_returnflag AS caller
  FROM lineitem
)"""


def timing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timing samples of endpoints, commands and queue topics."""
    e = table(spark, sf_dir, "events")
    number, user = F.col("event_id"), F.col("user_id")
    kind = F.when(number % 3 == 0, "http").when(number % 3 == 1, "cli").otherwise("mq")
    path = (
        F.when(
            number % 3 == 0,
            F.concat(F.lit("/u"), user % 20, F.lit("/"), user, F.lit("/"), number, F.lit("/x?q="), user),
        )
        .when(number % 3 == 1, F.concat(F.lit("cli:job/"), user % 5))
        .otherwise(F.concat(F.lit("mq://topic/"), user % 4))
    )
    status = F.when(number % 5 == 0, 404).when(number % 5 == 1, F.lit(None)).otherwise(200)
    return e.select(
        path.alias("path"),
        kind.alias("type"),
        F.col("value").alias("ms"),
        status.cast("int").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        number.alias("seq"),
    )


TIMING_SQL = r"""
v_timing AS (
  SELECT CASE event_id % 3
      WHEN 0 THEN '/u' || (user_id % 20) || '/' || user_id || '/' || event_id || '/x?q=' || user_id
      WHEN 1 THEN 'cli:job/' || (user_id % 5) ELSE 'mq://topic/' || (user_id % 4) END AS path,
    CASE event_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'cli' ELSE 'mq' END AS type,
    value AS ms, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS status,
    ts, event_id AS seq
  FROM events
)"""


# The moment the fleet is looked at.
NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def host_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as host snapshots with cumulative counters that restart now and then."""
    e = table(spark, sf_dir, "events")
    number, user = F.col("event_id"), F.col("user_id")
    host = F.concat(F.lit("web"), user % 20)
    ip = F.concat(F.lit("10.0.0."), user % 20)
    step = number % 4000
    procs = F.transform(
        F.sequence(F.lit(1), F.lit(13)),
        lambda i: F.struct(
            (number * 16 + i).cast("string").alias("pid"),
            F.concat(F.lit("u"), i % 3).alias("user"),
            ((number * 7 + i * i * 31) % 977 * 64).cast("bigint").alias("ticks"),
            (i * 100).cast("bigint").alias("start_ticks"),
            ((number + i * 37) % 256 * 16).cast("bigint").alias("rss_kb"),
            F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("run "), i)).alias("command"),
        ),
    )
    return e.select(
        F.substring(F.md5(F.concat(host, ip)), 1, 12).alias("instance_id"),
        host.alias("hostname"),
        ip.alias("ip"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        (F.lit(4103.0) + number % 2).alias("uptime_s"),
        F.struct(
            (number % 640 / 64).alias("m1"), F.lit(1.0).alias("m5"), F.lit(0.5).alias("m15")
        ).alias("load"),
        F.struct(
            F.lit(16384).cast("bigint").alias("total"),
            F.lit(64).cast("bigint").alias("free"),
            F.when(number % 11 != 0, 16384 - 64 * (number % 256)).cast("bigint").alias("available"),
        ).alias("mem"),
        F.struct(
            F.lit(8).alias("cores"),
            (step * 64).cast("bigint").alias("total"),
            (step * 40 + number % 13 * 16).cast("bigint").alias("idle"),
        ).alias("cpu"),
        F.struct(
            F.lit(65536).cast("bigint").alias("total"),
            (user % 128 * 512).cast("bigint").alias("free"),
        ).alias("disk"),
        procs.alias("procs"),
    )


HOST_SQL = rf"""
v_host AS (
  SELECT substr(md5('web' || (user_id % 20) || '10.0.0.' || (user_id % 20)), 1, 12) AS instance_id,
    'web' || (user_id % 20) AS hostname, '10.0.0.' || (user_id % 20) AS ip, ts AS collected_at,
    4103.0::DOUBLE + event_id % 2 AS uptime_s, (event_id % 640) / 64.0::DOUBLE AS m1,
    CASE WHEN event_id % 11 <> 0 THEN 16384 - 64 * (event_id % 256) ELSE 64 END AS mem_available,
    16384 AS mem_total, 65536 AS disk_total, (user_id % 128) * 512 AS disk_free,
    (event_id % 4000) * 64 AS cpu_total, (event_id % 4000) * 40 + (event_id % 13) * 16 AS cpu_idle,
    event_id, TIMESTAMP '{NOW}' AS now_at
  FROM events
)"""


def plan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as stored query plans of one to three levels."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    leaf = F.concat(
        F.lit('{"Node Type": "Index Scan", "Index Name": "ix_'), size % 5,
        F.lit('", "Index Cond": "(id = '), key, F.lit(')", "Total Cost": 8.25, "Plan Rows": 1}'),
    )
    scan = F.concat(
        F.lit('{"Node Type": "Seq Scan", "Startup Cost": 0.0, "Total Cost": '), size,
        F.lit('.5, "Plan Rows": '), key, F.lit(', "Filter": "(size > '), size, F.lit(')"}'),
    )
    join = F.concat(
        F.lit('{"Node Type": "Nested Loop", "Startup Cost": 1.5, "Total Cost": '), key,
        F.lit('.25, "Plan Rows": '), size, F.lit(', "Plans": ['), scan, F.lit(", "), leaf, F.lit("]}"),
    )
    deep = F.concat(
        F.lit('{"Node Type": "Sort", "Startup Cost": 2.5, "Total Cost": 99.75, "Plan Rows": 7, "Plans": ['),
        join, F.lit("]}"),
    )
    root = (
        F.when(key % 4 == 0, leaf).when(key % 4 == 1, scan).when(key % 4 == 2, join).otherwise(deep)
    )
    return p.select(
        F.concat(F.lit("SELECT "), key).alias("template"),
        F.concat(F.lit('[{"Plan": '), root, F.lit("}]")).alias("plan_json"),
    )


PLAN_SQL = r"""
v_plan AS (
  SELECT 'SELECT ' || p_partkey AS template, p_partkey % 4 AS shape, '[{"Plan": ' ||
    CASE p_partkey % 4 WHEN 0 THEN leaf WHEN 1 THEN scan WHEN 2 THEN join_node
      ELSE '{"Node Type": "Sort", "Startup Cost": 2.5, "Total Cost": 99.75, "Plan Rows": 7, "Plans": ['
        || join_node || ']}' END || '}]' AS plan_json
  FROM (SELECT *, '{"Node Type": "Nested Loop", "Startup Cost": 1.5, "Total Cost": ' || p_partkey
          || '.25, "Plan Rows": ' || p_size || ', "Plans": [' || scan || ', ' || leaf || ']}' AS join_node
        FROM (SELECT *,
            '{"Node Type": "Index Scan", "Index Name": "ix_' || (p_size % 5) || '", "Index Cond": "(id = '
              || p_partkey || ')", "Total Cost": 8.25, "Plan Rows": 1}' AS leaf,
            '{"Node Type": "Seq Scan", "Startup Cost": 0.0, "Total Cost": ' || p_size
              || '.5, "Plan Rows": ' || p_partkey || ', "Filter": "(size > ' || p_size || ')"}' AS scan
          FROM part))
)"""
