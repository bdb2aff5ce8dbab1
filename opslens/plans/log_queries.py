"""Queries over log lines and grouped records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.levels import occurrence_class, repeat_class
from ..functions.loglines import carried_time, parse_records, resolve_origin
from ..operators.digest import (
    exception_digest,
    repeated_lines,
    throughput_labels,
    throughput_minutes,
)
from ..operators.grouping import (
    as_single_rows,
    channels,
    count_expired,
    expire_by_age,
    expire_by_size,
    group_records,
    merge_groups,
    table_stats,
)
from ..operators.ordering import carry_time, last_lines
from ..operators.search import (
    at_least,
    contains_any_case,
    error_spikes,
    grep,
    grep_files,
    in_channels,
    level_counts,
    level_lines,
    line_matches,
    match_counts,
    non_empty,
    search_records,
    table_tail,
)
from ..options import Options
from .views import (
    DOCUMENT_SQL,
    EXCEPTION_SQL,
    LOG_SQL,
    NOW,
    document_lines,
    exception_view,
    lines,
    log_view,
    now,
    table,
)

NTZ = "timestamp_ntz"
# Digests of everything, where the limits are not the point.
ALL = Options(exception_groups=None, repeat_groups=None, throughput_minutes=None)
GREP_FILES = ("error.log", "view.log", "click.log")


def _ntz(*names: str):
    return [F.col(n).cast(NTZ).alias(n) for n in names]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(lines(log_view(spark, sf_dir)))


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(
        "file", "seq", *_ntz("ts"), "channel", "level", "level_name", "message", "context", "extra"
    )


LOG_PARSE = f"""
WITH {LOG_SQL}
SELECT file, seq, ts, channel, level, level_name, message, context, NULL::VARCHAR AS extra FROM v_log"""


def log_parse_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose context and extra nest, with braces and quotes in their strings."""
    view = log_view(spark, sf_dir)
    number = F.col("seq").cast("string")
    context = F.concat(F.lit('{"a":{"b":[{"n":'), number, F.lit('},[[]]],"s":"} \\" {"},"t":"x"}'))
    extra = F.concat(F.lit('{"e":{"f":{"g":'), number, F.lit("}}}"))
    head = F.regexp_extract("line", r"^(\[[^\]]+\] \S+ [^{]*)", 1)
    records = parse_records(
        lines(view.withColumn("line", F.concat(head, context, F.lit(" "), extra)))
    )
    return records.select("file", "seq", "message", "context", "extra")


LOG_PARSE_NESTED = f"""
WITH {LOG_SQL}
SELECT file, seq, message,
  '{{"a":{{"b":[{{"n":' || seq || '}},[[]]],"s":"}} \\" {{"}},"t":"x"}}' AS context,
  '{{"e":{{"f":{{"g":' || seq || '}}}}}}' AS extra FROM v_log"""


def log_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_records(at_least(_records(spark, sf_dir), "WARNING"))
    return groups.select(
        "message_key", "channel", "level", "level_name", "message", "context",
        *_ntz("first_seen", "last_seen"), "occurrences",
    )


GROUPED_SQL = """
keyed AS (SELECT *, md5(channel || '|' || level || '|' || substr(message, 1, 30)) AS message_key FROM v_log),
ranked AS (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY ts DESC, seq) AS newest FROM keyed)"""

LOG_GROUPS = f"""
WITH {LOG_SQL}, {GROUPED_SQL}
SELECT message_key, any_value(channel) AS channel, any_value(level)::INTEGER AS level,
  any_value(level_name) AS level_name, max(message) FILTER (newest = 1) AS message,
  max(context) FILTER (newest = 1) AS context, min(ts) AS first_seen, max(ts) AS last_seen,
  count(*) AS occurrences
FROM ranked WHERE level >= 300 GROUP BY message_key"""


def log_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_single_rows(in_channels(_records(spark, sf_dir), ("app0", "app2")))
    return rows.select("channel", "level", "message", "context", "extra", *_ntz("first_seen"), "occurrences")


LOG_UNGROUPED = f"""
WITH {LOG_SQL}
SELECT channel, level::INTEGER AS level, message, context, NULL::VARCHAR AS extra, ts AS first_seen,
  1::BIGINT AS occurrences FROM v_log WHERE channel IN ('app0', 'app2')"""


def record_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url from the context, ip from extra; pages give the urls."""
    p = table(spark, sf_dir, "pages")
    rows = p.select(
        F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct("url"))).alias("context"),
        F.to_json(F.struct(F.col("url"), F.col("page_id").cast("string").alias("ip"))).alias("extra"),
        F.lit("/env").alias("url"),
        F.lit(None).cast("string").alias("ip"),
        "page_id",
    )
    return resolve_origin(rows).select("page_id", "url", "ip")


RECORD_ORIGIN = "SELECT page_id, substr(url, 1, 2000) AS url, page_id::VARCHAR AS ip FROM pages"


def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_lines(lines(log_view(spark, sf_dir)), 100).select("file", "seq", "line")


def _last_sql(n: int, where: str = "TRUE") -> str:
    return f"""
WITH {LOG_SQL}
SELECT file, seq, line FROM v_log WHERE {where}
QUALIFY row_number() OVER (PARTITION BY file ORDER BY seq DESC) <= {n}"""


def grep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basic pattern: the braces are plain, the escaped bar is an alternative."""
    hits = line_matches(r"app[12].*code [25] {.*k.: 1\|user 9 raised")
    return grep(lines(log_view(spark, sf_dir)), hits, 50).select("file", "seq", "line")


def grep_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = level_lines("ERROR", exact=False)
    return grep(lines(log_view(spark, sf_dir)), hits, 200).select("file", "seq", "line")


def grep_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = Options(grep_limit_per_file=1000, grep_limit_total=2000)
    hits = line_matches("code 3", literal=True)
    return grep_files(lines(log_view(spark, sf_dir)), hits, GREP_FILES, opts).select("file", "seq", "line")


GREP_SEVERAL = f"""
WITH {LOG_SQL},
hits AS (
  SELECT file, seq, line, list_position({list(GREP_FILES)}, file) AS file_rank FROM v_log
  WHERE contains(line, 'code 3') AND file IN {GREP_FILES}
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY seq DESC) <= 1000)
SELECT file, seq, line FROM hits ORDER BY file_rank DESC, seq DESC LIMIT 2000"""


def icontains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contains_any_case(lines(log_view(spark, sf_dir)), " RAISED Purchase code 4").select(
        "file", "seq", "line"
    )


ICONTAINS = f"""
WITH {LOG_SQL}
SELECT file, seq, line FROM v_log WHERE contains(lower(line), 'raised purchase code 4')"""


def grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(non_empty(document_lines(spark, sf_dir)), line_matches("[0-9]"))


GREP_COUNTS = f"""
WITH {DOCUMENT_SQL}
SELECT file, count(*) FILTER (regexp_matches(line, '[0-9]')) AS matches
FROM v_doc_lines WHERE line <> '' GROUP BY file"""


def level_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(lines(log_view(spark, sf_dir)).unionByName(exception_view(spark, sf_dir)))


LEVEL_MARKS = f"""
WITH {LOG_SQL}, {EXCEPTION_SQL},
marked AS (SELECT file, line FROM v_log UNION ALL SELECT file, line FROM v_exc)
SELECT file, sum(len(regexp_extract_all(line, '\\.(ERROR|CRITICAL):')))::BIGINT AS errors,
  sum(len(regexp_extract_all(line, '\\.WARNING:')))::BIGINT AS warnings,
  sum(len(regexp_extract_all(line, '\\.INFO:')))::BIGINT AS infos
FROM marked GROUP BY file"""


def error_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_spikes(exception_view(spark, sf_dir).unionByName(lines(log_view(spark, sf_dir))))


ERROR_SPIKE = f"""
WITH {LOG_SQL}, {EXCEPTION_SQL},
marked AS (SELECT file, seq, line FROM v_log UNION ALL SELECT file, seq, line FROM v_exc),
newest AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY file ORDER BY seq DESC) <= 500)
SELECT file, count(*) FILTER (regexp_matches(line, '\\.(ERROR|CRITICAL):')) AS errors,
  count(*) FILTER (regexp_matches(line, '\\.(ERROR|CRITICAL):')) >= 20 AS spike
FROM newest GROUP BY file"""


def carried_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the time it falls under, handed on over many chunks of a file."""
    marked = exception_view(spark, sf_dir).withColumn("line_ts", carried_time("line"))
    return carry_time(marked, bits=8).select("file", "seq", *_ntz("carried"))


CARRIED_SQL = r"""
timed AS (
  SELECT file, seq, line, last_value(TRY_CAST(nullif(regexp_extract(line,
      '^\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})[^\]]*\]', 1), '') AS TIMESTAMP) IGNORE NULLS)
    OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS carried
  FROM {source})"""

CARRIED_TIMES = f"WITH {EXCEPTION_SQL}, {CARRIED_SQL.replace('{source}', 'v_exc')} SELECT file, seq, carried FROM timed"


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(exception_digest(exception_view(spark, sf_dir), opts=ALL))


def exceptions_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(exception_digest(exception_view(spark, sf_dir), 500))


def _digest_columns(digest: DataFrame) -> DataFrame:
    return digest.select(
        "file", F.col("rank").cast("bigint").alias("rank"), "class", "message", "count",
        *_ntz("first_seen", "last_seen"),
    )


def _exceptions_sql(tail: int | None) -> str:
    cut = (
        f"SELECT * FROM v_exc QUALIFY row_number() OVER (PARTITION BY file ORDER BY seq DESC) <= {tail}"
        if tail
        else "SELECT * FROM v_exc"
    )
    cls = r"([\w\\]*\w(?:Exception|Error|Throwable))(?:\(code:[^)]*\))?"
    first = r"\[object\]\s*\(" + cls + r":\s*(.{0,200}?)(?:\s+at\s+\S+|\s+in\s+\S+|\\n|$)"
    second = r"\.(?:ERROR|CRITICAL).*?" + cls + r"[:\s]+(.{0,160}?)(?:\s*\{|$)"
    return rf"""
WITH {EXCEPTION_SQL}, scanned AS ({cut}), {CARRIED_SQL.replace('{source}', 'scanned')},
found AS (
  SELECT *, CASE WHEN regexp_matches(line, '{first}')
      THEN regexp_extract(line, '{first}', ['class', 'message'])
      WHEN regexp_matches(line, '{second}')
      THEN regexp_extract(line, '{second}', ['class', 'message']) END AS e
  FROM timed),
cleaned AS (
  SELECT file, seq, carried, e['class'] AS class, rtrim(trim(e['message']), '"''') AS message
  FROM found WHERE e IS NOT NULL),
keyed AS (
  SELECT *, class || ':' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(message, '(?i)\b[0-9a-f]{{6,}}\b', '', 'g'), '\(\d+\)', '', 'g'),
    '\bat\s+\S+:\d+', '', 'g'), '\bin\s+\S+:\d+', '', 'g'), '(?i)line\s+\d+', '', 'g'),
    '\s+', ' ', 'g')) AS key
  FROM cleaned),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY seq) AS n FROM keyed),
grouped AS (
  SELECT file, key, count(*) AS count, min(seq) AS at, max(seq) FILTER (carried IS NOT NULL) AS last_at
  FROM numbered GROUP BY file, key)
SELECT g.file, row_number() OVER (PARTITION BY g.file ORDER BY g.count DESC, g.at) AS rank,
  f.class, f.message, g.count, f.carried AS first_seen, l.carried AS last_seen
FROM grouped g
JOIN numbered f ON f.file = g.file AND f.key = g.key AND f.n = 1
LEFT JOIN numbered l ON l.file = g.file AND l.key = g.key AND l.seq = g.last_at
{"QUALIFY rank <= 50" if tail else ""}"""


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeat_columns(repeated_lines(exception_view(spark, sf_dir), opts=ALL))


def repeats_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeat_columns(repeated_lines(document_lines(spark, sf_dir), opts=ALL))


def _repeat_columns(digest: DataFrame) -> DataFrame:
    return digest.select(
        "file", F.col("rank").cast("bigint").alias("rank"), "message", "level", "channel", "count",
        "first_seen", "last_seen", repeat_class("count").alias("class"),
    )


def _repeats_sql(view: str, source: str) -> str:
    stamp = r"^\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\]]*)\]\s*"
    return rf"""
WITH {view},
trimmed AS (
  SELECT file, seq, rtrim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) AS line FROM {source}),
stamped AS (
  SELECT file, seq, nullif(regexp_extract(line, '{stamp}', 1), '') AS stamp,
    regexp_replace(line, '{stamp}', '') AS text
  FROM trimmed),
keyed AS (
  SELECT *, regexp_replace(text, '[\s\v]+', ' ', 'g') AS key,
    regexp_extract(text, '^([a-zA-Z0-9_\-]+)\.([A-Z]+):\s', 1) AS channel,
    regexp_extract(text, '^([a-zA-Z0-9_\-]+)\.([A-Z]+):\s', 2) AS level
  FROM stamped WHERE text <> ''),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY seq) AS n,
    row_number() OVER (PARTITION BY file, key ORDER BY (stamp IS NULL), seq DESC) AS back
  FROM keyed),
grouped AS (SELECT file, key, count(*) AS count, min(seq) AS at FROM numbered GROUP BY file, key HAVING count(*) > 1)
SELECT g.file, row_number() OVER (PARTITION BY g.file ORDER BY g.count DESC, g.at) AS rank,
  f.text AS message, f.level, f.channel, g.count, coalesce(f.stamp, '') AS first_seen,
  coalesce(l.stamp, '') AS last_seen,
  CASE WHEN g.count >= 10 THEN 'high' WHEN g.count >= 3 THEN 'mid' ELSE 'low' END AS class
FROM grouped g
JOIN numbered f ON f.file = g.file AND f.key = g.key AND f.n = 1
JOIN numbered l ON l.file = g.file AND l.key = g.key AND l.back = 1"""


def throughput_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = lines(log_view(spark, sf_dir)).unionByName(exception_view(spark, sf_dir))
    return throughput_labels(both, opts=ALL)


THROUGHPUT_LABEL = rf"""
WITH {LOG_SQL}, {EXCEPTION_SQL},
marked AS (SELECT file, line FROM v_log UNION ALL SELECT file, line FROM v_exc),
labelled AS (
  SELECT file, nullif(regexp_extract(line, '^\[\d{{4}}-\d{{2}}-\d{{2}}[T ](\d{{2}}:\d{{2}})', 1), '') AS label
  FROM marked WHERE line <> ''),
totals AS (SELECT file, count(*) AS total_lines FROM labelled GROUP BY file),
counted AS (
  SELECT file, label, count(*) AS lines FROM labelled WHERE label IS NOT NULL GROUP BY file, label)
SELECT c.file, c.label, c.lines, max(c.lines) OVER (PARTITION BY c.file) AS max_lines, t.total_lines
FROM counted c JOIN totals t USING (file)"""


def throughput_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput_minutes(lines(log_view(spark, sf_dir))).select("file", *_ntz("minute"), "lines")


THROUGHPUT_MINUTE = f"""
WITH {LOG_SQL}
SELECT file, date_trunc('minute', ts) AS minute, count(*) AS lines FROM v_log GROUP BY 1, 2"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records grouped per ten-day batch, the batches numbered as versions."""
    batch = F.floor((F.dayofmonth("ts") - 1) / 10).cast("bigint")
    return group_records(_records(spark, sf_dir).withColumn("version", batch), by=("version",))


def log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches merged by time equal one batch."""
    return merge_groups(_batches(spark, sf_dir), "time").select(
        "message_key", "channel", "level", "context", *_ntz("first_seen", "last_seen"), "occurrences",
        occurrence_class("occurrences").alias("class"),
    )


LOG_MERGE = f"""
WITH {LOG_SQL}, {GROUPED_SQL}
SELECT message_key, any_value(channel) AS channel, any_value(level)::INTEGER AS level,
  max(context) FILTER (newest = 1) AS context, min(ts) AS first_seen, max(ts) AS last_seen,
  count(*) AS occurrences,
  CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 10 THEN 'mid' WHEN count(*) > 1 THEN 'low'
    ELSE 'single' END AS class
FROM ranked GROUP BY message_key"""


def log_merge_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches arrive newest first: last write wins, first batch keeps its first time."""
    late_first = _batches(spark, sf_dir).withColumn("version", F.lit(10) - F.col("version"))
    return merge_groups(late_first, "arrival").select(
        "message_key", "context", *_ntz("first_seen", "last_seen"), "occurrences"
    )


LOG_MERGE_ARRIVAL = f"""
WITH {LOG_SQL}, {GROUPED_SQL},
batched AS (SELECT *, 10 - (day(ts) - 1) // 10 AS version FROM keyed),
per_batch AS (
  SELECT message_key, version, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n
  FROM batched GROUP BY message_key, version),
newest AS (
  SELECT message_key, version, context FROM batched
  QUALIFY row_number() OVER (PARTITION BY message_key, version ORDER BY ts DESC, seq) = 1),
ordered AS (
  SELECT p.*, w.context,
    row_number() OVER (PARTITION BY p.message_key ORDER BY p.version) AS up,
    row_number() OVER (PARTITION BY p.message_key ORDER BY p.version DESC) AS down
  FROM per_batch p JOIN newest w USING (message_key, version))
SELECT message_key, max(context) FILTER (down = 1) AS context, max(first_seen) FILTER (up = 1) AS first_seen,
  max(last_seen) FILTER (down = 1) AS last_seen, sum(n)::BIGINT AS occurrences
FROM ordered GROUP BY message_key"""


def retention_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = expire_by_age(_records(spark, sf_dir), now(), 24 * 7, "ts")
    return kept.select("file", "seq", *_ntz("ts"))


RETENTION_AGE = f"""
WITH {LOG_SQL}
SELECT file, seq, ts FROM v_log WHERE NOT ts < TIMESTAMP '{NOW}' - INTERVAL 168 HOUR"""


def retention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_expired(_records(spark, sf_dir), now(), 24 * 7, "ts")


RETENTION_COUNT = f"""
WITH {LOG_SQL}
SELECT count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 168 HOUR) AS expired FROM v_log"""


def retention_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept at a limit of 70 % of their size."""
    rows = lines(log_view(spark, sf_dir)).withColumnRenamed("seq", "id")
    size = rows.agg(F.sum(F.length("line"))).first()[0]
    return expire_by_size(rows, size, limit_bytes=size * 7 // 10).select("file", "id")


RETENTION_SIZE = f"""
WITH {LOG_SQL},
totals AS (SELECT sum(length(line))::BIGINT AS size, count(*) AS n FROM v_log),
cut AS (
  SELECT least(ceil((size - size * 7 // 10) * 1.2::DOUBLE / ceil(size / n)), floor(n * 0.9::DOUBLE)) AS rows_cut
  FROM totals)
SELECT file, seq AS id FROM v_log, cut QUALIFY row_number() OVER (ORDER BY seq) > rows_cut"""


def log_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    groups = group_records(records.where("level >= 300"))
    single = as_single_rows(records.where("level < 300"))
    return table_stats(groups.unionByName(single.select(*groups.columns))).drop("table_size_bytes")


LOG_TABLE_STATS = f"""
WITH {LOG_SQL}, {GROUPED_SQL},
stored AS (
  SELECT message_key, count(*) AS n FROM keyed WHERE level >= 300 GROUP BY message_key
  UNION ALL SELECT NULL, 1 FROM keyed WHERE level < 300)
SELECT count(*) AS total_rows, count(message_key) AS grouped_rows, sum(n)::BIGINT AS total_occurrences
FROM stored"""


def log_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(_records(spark, sf_dir))


LOG_CHANNELS = f"WITH {LOG_SQL} SELECT DISTINCT channel FROM v_log ORDER BY channel"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumnRenamed("seq", "id")


def log_table_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search_records(_stored(spark, sf_dir), level="error", search="user 3% code")
    return table_tail(rows, limit=50).select("id", "channel", "message")


LOG_TABLE_TAIL = f"""
WITH {LOG_SQL}
SELECT seq AS id, channel, message FROM v_log
WHERE level_name = 'ERROR' AND message LIKE '%user 3% code%' ORDER BY seq DESC LIMIT 50"""


def log_table_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search_records(_stored(spark, sf_dir), channel="app1")
    return table_tail(rows, after_id=500, limit=40).select("id", "channel", "message")


LOG_TABLE_AFTER = f"""
WITH {LOG_SQL}
SELECT seq AS id, channel, message FROM v_log WHERE channel = 'app1' AND seq > 500 ORDER BY seq LIMIT 40"""


QUERIES = {
    "log_parse": (log_parse, LOG_PARSE),
    "log_parse_nested": (log_parse_nested, LOG_PARSE_NESTED),
    "log_groups": (log_groups, LOG_GROUPS),
    "log_ungrouped": (log_ungrouped, LOG_UNGROUPED),
    "record_origin": (record_origin, RECORD_ORIGIN),
    "tail_n": (tail_n, _last_sql(100)),
    "grep_last": (
        grep_last,
        _last_sql(50, r"regexp_matches(line, 'app[12].*code [25] \{.*k.: 1|user 9 raised')"),
    ),
    "grep_level": (grep_level, _last_sql(200, "regexp_matches(line, '.ERROR:')")),
    "grep_several": (grep_several, GREP_SEVERAL),
    "icontains": (icontains, ICONTAINS),
    "grep_counts": (grep_counts, GREP_COUNTS),
    "level_counts": (level_marks, LEVEL_MARKS),
    "error_spike": (error_spike, ERROR_SPIKE),
    "carried_times": (carried_times, CARRIED_TIMES),
    "exception_digest": (exceptions, _exceptions_sql(None)),
    "exception_digest_tail": (exceptions_tail, _exceptions_sql(500)),
    "repeated_lines": (repeats, _repeats_sql(EXCEPTION_SQL, "v_exc")),
    "repeated_doc_lines": (repeats_in_documents, _repeats_sql(DOCUMENT_SQL, "v_doc_lines")),
    "throughput_label": (throughput_label, THROUGHPUT_LABEL),
    "throughput_minute": (throughput_minute, THROUGHPUT_MINUTE),
    "log_merge": (log_merge, LOG_MERGE),
    "log_merge_arrival": (log_merge_arrival, LOG_MERGE_ARRIVAL),
    "retention_age": (retention_age, RETENTION_AGE),
    "retention_count": (retention_count, RETENTION_COUNT),
    "retention_size": (retention_size, RETENTION_SIZE),
    "table_stats": (log_table_stats, LOG_TABLE_STATS),
    "channels": (log_channels, LOG_CHANNELS),
    "table_tail": (log_table_tail, LOG_TABLE_TAIL),
    "table_after": (log_table_after, LOG_TABLE_AFTER),
}
