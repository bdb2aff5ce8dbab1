"""Queries over SQL samples, issues and stored plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import CLIP, clip, command_url, mask_params, request_url, sql_template
from ..operators.ordering import first_per_request
from ..operators.search import view_rows
from ..operators.sqltrack import (
    as_deltas,
    explain_candidates,
    issue_brief,
    issue_rows,
    issues_of,
    merge_issues,
    summarise_plans,
    template_stats,
    templated,
    with_plan_note,
)
from ..options import Options
from .views import PLAN_SQL, SAMPLE_SQL, plan_view, sample_view, table

# Orders hold few items, so the thresholds are low. Issues count every sample of a request; the cap is
# the matter of sql_template_stats and first_samples.
OPTS = Options(n1_threshold=2, slow_sql_ms=10.0, samples_per_request=None)
CAP = Options(n1_threshold=2, samples_per_request=3)

TEMPLATED_SQL = rf"""
{SAMPLE_SQL},
templated AS (
  SELECT request_id, seq, ts, url, caller, round(ms, 1) AS ms,
    regexp_replace(params_json, '"Api_Token":"[^"]*"', '"Api_Token":"***"') AS params_json,
    'SELECT * FROM ' || CASE WHEN contains(sql, 'FROM part ') THEN 'part' ELSE 'stock_2' END
      || ' WHERE id = ? AND price > ? AND kind IN (?) AND name = ?' AS template
  FROM v_sql)"""


def _stats_sql(cap: int | None) -> str:
    capped = f"QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seq) <= {cap}" if cap else ""
    return f"""
{TEMPLATED_SQL},
kept AS (
  SELECT * FROM templated {capped}),
worst AS (
  SELECT request_id, template, caller, params_json FROM kept
  QUALIFY row_number() OVER (PARTITION BY request_id, template ORDER BY ms DESC, seq) = 1),
per_set AS (
  SELECT request_id, template, params_json, count(*) AS n FROM kept GROUP BY ALL),
sets AS (
  SELECT request_id, template, count(*) AS unique_params, max(n) AS same_params_max
  FROM per_set GROUP BY ALL),
stats AS (
  SELECT k.request_id, k.template, any_value(k.url) AS url, count(*) AS executions,
    any_value(s.unique_params) AS unique_params, any_value(s.same_params_max) AS same_params_max,
    round(min(ms), 1) AS min_ms, round(max(ms), 1) AS max_ms,
    sum((ms * 10)::BIGINT)::BIGINT / 10.0::DOUBLE AS total_ms,
    ((2 * sum((ms * 10)::BIGINT)::BIGINT + count(*)) // (2 * count(*))) / 10.0::DOUBLE AS avg_ms, any_value(w.caller) AS caller,
    any_value(w.params_json) AS params_json, max(ts) AS last_seen
  FROM kept k JOIN worst w USING (request_id, template) JOIN sets s USING (request_id, template)
  GROUP BY k.request_id, k.template)"""


ISSUES_SQL = f"""
{_stats_sql(None)},
flagged AS (
  SELECT *, executions > 2 AS is_n1, max_ms > 10 AS is_slow FROM stats
  WHERE executions > 2 OR max_ms > 10),
issues AS (
  SELECT *, CASE WHEN is_n1 THEN executions END AS worst_n1,
    CASE WHEN is_slow AND is_n1 THEN total_ms WHEN is_slow THEN max_ms END AS worst_slow_ms
  FROM flagged)"""


def sql_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templated(sample_view(spark, sf_dir)).select(
        "request_id", "seq", "template", "ms", "params_json", "fingerprint"
    )


SQL_TEMPLATES = f"""
WITH {TEMPLATED_SQL}
SELECT request_id, seq, template, ms, params_json, md5(params_json) AS fingerprint FROM templated"""


def sql_template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_stats(sample_view(spark, sf_dir), CAP).select(
        "request_id", "template", "url", "executions", "unique_params", "same_params_max",
        "min_ms", "max_ms", "total_ms", "caller", "params_json",
    )


SQL_TEMPLATE_STATS = f"""
WITH {_stats_sql(3)}
SELECT request_id, template, url, executions, unique_params, same_params_max, min_ms, max_ms, total_ms,
  caller, params_json FROM stats"""


def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_request(sample_view(spark, sf_dir), 2).select("request_id", "seq")


FIRST_SAMPLES = f"""
WITH {SAMPLE_SQL}
SELECT request_id, seq FROM v_sql QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seq) <= 2"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues_of(sample_view(spark, sf_dir), OPTS)


def sql_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select(
        "request_id", "template", "is_n1", "is_slow", "executions", "worst_n1", "worst_slow_ms",
        "caller", "params_json", "url", "reason",
        *[F.col(f"analysis.{n}").alias(n) for n in (
            "unique_params", "same_params_max", "all_identical", "avg_ms", "min_ms", "max_ms", "total_ms"
        )],
    )


SQL_ISSUES = f"""
WITH {ISSUES_SQL}
SELECT request_id, template, is_n1, is_slow, executions, worst_n1, worst_slow_ms, caller, params_json, url,
  concat_ws('+', CASE WHEN NOT is_n1 THEN NULL WHEN unique_params = 1 THEN 'n1_identical'
      WHEN same_params_max > 1 THEN 'n1_partly_repeated' ELSE 'n1_distinct' END,
    CASE WHEN NOT is_slow THEN NULL WHEN is_n1 THEN 'slow_total' ELSE 'slow_single' END) AS reason,
  unique_params, same_params_max, unique_params = 1 AND executions > 1 AS all_identical, avg_ms,
  min_ms, max_ms, total_ms
FROM issues"""


def sql_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("request_id", "template", "suggestion")


def _number(column: str) -> str:
    return rf"regexp_replace({column}::VARCHAR, '\.0$', '')"


SQL_ADVICE = f"""
WITH {ISSUES_SQL}
SELECT request_id, template, concat_ws(' ',
  CASE WHEN NOT is_n1 THEN NULL
    WHEN unique_params = 1 THEN 'Ran ' || executions
      || ' times with the same parameters: keep the first result and reuse it.'
    WHEN same_params_max > 1 THEN 'Ran ' || executions || ' times with ' || unique_params
      || ' parameter sets, one of them ' || same_params_max
      || ' times: cache the repeats and fetch the rest in one query.'
    ELSE 'Ran ' || executions
      || ' times, each with other parameters: fetch them together in one query over a list of keys.' END,
  CASE WHEN NOT is_slow THEN NULL
    WHEN is_n1 THEN 'All runs took ' || {_number('total_ms')} || ' ms, ' || {_number('avg_ms')}
      || ' ms each: reduce their number before tuning the query.'
    ELSE 'Took up to ' || {_number('max_ms')} || ' ms, ' || {_number('avg_ms')}
      || ' ms on average: look at its plan.' END) AS suggestion
FROM issues"""


def explain_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain_candidates(_issues(spark, sf_dir)).select("request_id", "template")


# Two templates per request at most, so the limit of three never cuts here.
EXPLAIN_PICKS = f"WITH {ISSUES_SQL} SELECT request_id, template FROM issues WHERE is_slow"


def explain_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first slow template of a request, where many have two."""
    return explain_candidates(_issues(spark, sf_dir), 1).select("request_id", "template")


EXPLAIN_FIRST = f"""
WITH {ISSUES_SQL},
first AS (SELECT request_id, template, min(seq) AS first_seq FROM kept GROUP BY ALL)
SELECT request_id, template FROM issues JOIN first USING (request_id, template) WHERE is_slow
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY first_seq, template) = 1"""


def sql_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as statements over one table per type."""
    p = table(spark, sf_dir, "part")
    sql = F.concat(
        F.lit("SELECT a.*, 'it''s' FROM "), F.replace("p_type", F.lit(" "), F.lit("_")),
        F.lit(" a  WHERE size = "), F.col("p_size"), F.lit("\n AND name in ('"), F.col("p_brand"), F.lit("', 'x')"),
    )
    return p.select(sql_template(sql).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("statements"))


SQL_SHAPES = """
SELECT 'SELECT a.*, ?? FROM ' || replace(p_type, ' ', '_') || ' a WHERE size = ? AND name IN (?)' AS template,
  count(*) AS statements FROM part GROUP BY 1"""


def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts longer than each stored column. A row of a few bytes becomes texts of some 100 KB, so rows are
    dealt out first: splits by file size put a million into one task."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    long = F.repeat(F.concat("c_name", F.lit("é𝒳")), 4_000)
    return c.select("c_custkey", *[F.md5(clip(long, kind)).alias(kind) for kind in CLIP])


CLIPPED_TEXTS = "SELECT c_custkey, " + ", ".join(
    f"md5(substr(repeat(c_name || 'é𝒳', 4000), 1, {n})) AS {kind}" for kind, n in CLIP.items()
) + " FROM customer"


def mask_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with backslashes, escapes and capitals, repeated names, deep and wide nesting, numbers and
    characters that a parser may not keep, and what is not JSON."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    shapes = [
        ('{"App\\\\Token":"', '"}'), ('{"to\\u006ben":"', '","n":1}'), ('[{"Api_Key":"', '"},{"k":[2]}]'),
        ('{"SECRET":"', '"'), ('{"q":"say \\"token\\": 5","authKey":"', '"}'), ('{"plain":"token ', '"}'),
        ('{ "a" : 1e999, "auth" :[ "\\ud800", ', ' ], "b": "\\ud800"}'), ('{"token":', ',"x":1,"x":2,"token":{}}'),
        ("[" * 70 + '{"k":{"secret":[{"a":[[', "]]}]}}" + "]" * 70), ('{"auth":' + "[" * 70, "]" * 70 + ',"z":[]}'),
    ]
    params = F.lit(None)
    for i, (before, after) in enumerate(shapes):
        params = F.when(F.col("c_custkey") % len(shapes) == i, F.concat(F.lit(before), key, F.lit(after))).otherwise(params)
    return c.select("c_custkey", mask_params(params).alias("masked"))


MASK_ODD = r"""
SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN '{"App\\Token":"***"}' WHEN 1 THEN '{"to\u006ben":"***","n":1}'
  WHEN 2 THEN '[{"Api_Key":"***"},{"k":[2]}]' WHEN 3 THEN '"***"'
  WHEN 4 THEN '{"q":"say \"token\": 5","authKey":"***"}' WHEN 5 THEN '{"plain":"token ' || c_custkey || '"}'
  WHEN 6 THEN '{ "a" : 1e999, "auth" :"***", "b": "\ud800"}' WHEN 7 THEN '{"token":"***","x":1,"x":2,"token":"***"}'
  WHEN 8 THEN repeat('[', 70) || '{"k":{"secret":"***"}}' || repeat(']', 70) ELSE '{"auth":"***","z":[]}' END AS masked
FROM customer"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues stored in three batches by year, then merged."""
    deltas = as_deltas(_issues(spark, sf_dir)).withColumn(
        "version", F.floor(F.year("last_seen") / 3).cast("bigint")
    )
    return issue_rows(merge_issues(deltas))


def issue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select(
        "template", "is_n1", "is_slow", "executions", "worst_n1", "worst_slow_ms",
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
        F.col("analysis.executions").alias("last_executions"),
    )


ISSUE_MERGE = f"""
WITH {ISSUES_SQL}
SELECT template, bool_or(is_n1) AS is_n1, bool_or(is_slow) AS is_slow, sum(executions)::BIGINT AS executions,
  max(worst_n1) AS worst_n1, max(worst_slow_ms) AS worst_slow_ms, max(last_seen) AS last_seen,
  arg_max(executions, (last_seen, request_id)) AS last_executions
FROM issues GROUP BY template"""


def issue_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("template", "caller", "params_json", "url")


ISSUE_ATTRIBUTION = f"""
WITH {ISSUES_SQL},
walked AS (
  SELECT *, coalesce(worst_slow_ms, 0) AS slow, coalesce(worst_n1, 0) AS n1,
    max(coalesce(worst_slow_ms, 0)) OVER before AS slow_before, max(coalesce(worst_n1, 0)) OVER before AS n1_before,
    row_number() OVER (PARTITION BY template ORDER BY last_seen, request_id) AS step
  FROM issues WINDOW before AS (PARTITION BY template ORDER BY last_seen, request_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT template, caller, params_json, url FROM walked
WHERE step = 1 OR slow > slow_before OR n1 > n1_before
QUALIFY row_number() OVER (PARTITION BY template ORDER BY step DESC) = 1"""


def issue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = view_rows(
        _merged(spark, sf_dir), "issues", {"is_n1": True}, {"template": "stock"}, "executions"
    )
    return shown.select("template", "executions", "worst_n1")


ISSUE_VIEW = f"""
WITH {ISSUES_SQL}
SELECT template, sum(executions)::BIGINT AS executions, max(worst_n1) AS worst_n1 FROM issues
WHERE contains(template, 'stock') GROUP BY template HAVING bool_or(is_n1)"""


def mask_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as flat parameters, two of them sensitive."""
    c = table(spark, sf_dir, "customer")
    params = F.concat(
        F.lit('{"id":'), F.col("c_custkey"), F.lit(',"User_PassWord":"'), F.col("c_name"),
        F.lit('","authLevel":'), F.col("c_nationkey"), F.lit(',"name":"'), F.col("c_mktsegment"), F.lit('"}'),
    )
    return c.select("c_custkey", mask_params(params).alias("masked"))


MASK_FLAT = """
SELECT c_custkey, '{"id":' || c_custkey || ',"User_PassWord":"***","authLevel":"***","name":"'
  || c_mktsegment || '"}' AS masked FROM customer"""


def mask_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested parameters: a masked subtree, a masked leaf, a list left alone."""
    c = table(spark, sf_dir, "customer")
    params = F.concat(
        F.lit('{"row":{"id":'), F.col("c_custkey"), F.lit(',"api_key":"'), F.col("c_name"),
        F.lit('"},"credentials":{"a":['), F.col("c_nationkey"), F.lit(']},"list":["token",'),
        F.col("c_nationkey"), F.lit("]}"),
    )
    return c.select("c_custkey", mask_params(params).alias("masked"))


MASK_NESTED = """
SELECT c_custkey, '{"row":{"id":' || c_custkey || ',"api_key":"***"},"credentials":"***","list":["token",'
  || c_nationkey || ']}' AS masked FROM customer"""


def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.substring_index("url", "?", 1)
    query = F.when(F.col("url").contains("?"), F.substring_index("url", "?", -1))
    return p.select(
        "page_id", request_url(path, query).alias("url"), command_url(F.concat(F.lit("job:"), "page_id")).alias("command")
    )


REQUEST_URLS = """
SELECT page_id, CASE WHEN contains(url, '?') AND split_part(url, '?', -1) <> ''
    THEN split_part(url, '?', 1) || '?' || split_part(url, '?', -1)
    ELSE split_part(url, '?', 1) END AS url,
  'cli:job:' || page_id AS command FROM pages"""


def _plan_columns(plans: DataFrame) -> DataFrame:
    return plans.select(
        "template", "node_type", "total_cost", "startup_cost", "plan_rows", "index_name", "index_cond",
        "filter_cond", "scan_type", F.array_join("node_types", ">").alias("node_types"),
        F.array_join("indexes_used", ">").alias("indexes_used"),
    )


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(summarise_plans(plan_view(spark, sf_dir)))


PLAN_SUMMARY = f"""
WITH {PLAN_SQL},
roots AS (SELECT *, plan_json::JSON -> '$[0].Plan' AS root FROM v_plan)
SELECT template, root ->> 'Node Type' AS node_type, (root ->> 'Total Cost')::DOUBLE AS total_cost,
  (root ->> 'Startup Cost')::DOUBLE AS startup_cost, (root ->> 'Plan Rows')::BIGINT AS plan_rows,
  root ->> 'Index Name' AS index_name, root ->> 'Index Cond' AS index_cond, root ->> 'Filter' AS filter_cond,
  CASE shape WHEN 0 THEN 'index' WHEN 1 THEN 'seq_scan' ELSE 'other' END AS scan_type,
  CASE shape WHEN 0 THEN 'Index Scan' WHEN 1 THEN 'Seq Scan' WHEN 2 THEN 'Nested Loop>Seq Scan>Index Scan'
    ELSE 'Sort>Nested Loop>Seq Scan>Index Scan' END AS node_types,
  coalesce(regexp_extract(plan_json, 'ix_\\d'), '') AS indexes_used
FROM roots"""


def issue_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    return issues.select("request_id", "template", issue_brief().alias("brief"))


ISSUE_BRIEFS = f"""
WITH {ISSUES_SQL}, advised AS ({SQL_ADVICE.split('WITH', 1)[1].replace(ISSUES_SQL, '').strip()})
SELECT i.request_id, i.template, concat_ws(chr(10),
  'Template: ' || i.template,
  'Flags: ' || concat_ws('; ', CASE WHEN is_n1 THEN 'repeated per request: ' || worst_n1 END,
    CASE WHEN is_slow THEN 'slow, ms: ' || {_number('worst_slow_ms')} END),
  'Executions: ' || executions, 'Parameter sets: ' || unique_params,
  CASE WHEN unique_params = 1 AND executions > 1 THEN 'All parameters identical' END,
  'Total ms: ' || {_number('total_ms')},
  'Average, least, most ms: ' || concat_ws(', ', {_number('avg_ms')}, {_number('min_ms')}, {_number('max_ms')}),
  'Caller: ' || caller, 'Advice: ' || a.suggestion) AS brief
FROM issues i JOIN advised a USING (request_id, template)"""


def plan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as slow issues: advice extended by the scan, and the brief with its plan section."""
    plans = summarise_plans(plan_view(spark, sf_dir))
    issues = plans.select(
        "template", F.lit(True).alias("is_slow"), F.lit(False).alias("is_n1"), F.lit("Slow.").alias("suggestion"),
        F.lit(None).cast("bigint").alias("worst_n1"), F.col("total_cost").alias("worst_slow_ms"),
        F.lit("").alias("caller"),
        F.struct(
            F.lit(1).alias("executions"), F.lit(1).alias("unique_params"), F.lit(False).alias("all_identical"),
            *[F.lit(1.5).alias(n) for n in ("total_ms", "avg_ms", "min_ms", "max_ms")],
        ).alias("analysis"),
    )
    noted = with_plan_note(issues, plans)
    brief = issue_brief(plan=True)
    return noted.select("template", "suggestion", F.length(brief).cast("bigint").alias("brief_length"))


PLAN_NOTES = f"""
WITH {PLAN_SQL}, summary AS ({PLAN_SUMMARY.split('WITH', 1)[1].replace(PLAN_SQL + ',', 'WITH', 1).strip()}),
noted AS (
  SELECT *, concat_ws(' ', 'Slow.', CASE scan_type
    WHEN 'seq_scan' THEN 'The plan reads the whole table to test ' || filter_cond || ': an index may help.'
    WHEN 'index' THEN 'The plan uses index ' || indexes_used || '.' END) AS suggestion
  FROM summary)
SELECT template, suggestion, length(concat_ws(chr(10), 'Template: ' || template,
  'Flags: slow, ms: ' || {_number('total_cost')}, 'Executions: 1', 'Parameter sets: 1', 'Total ms: 1.5',
  'Average, least, most ms: 1.5, 1.5, 1.5', 'Plan root: ' || node_type, 'Scan: ' || scan_type,
  'Estimated cost: ' || {_number('total_cost')}, 'Estimated rows: ' || plan_rows,
  'Index condition: ' || index_cond, 'Filter: ' || filter_cond,
  CASE WHEN indexes_used <> '' THEN 'Indexes: ' || indexes_used END,
  'Plan nodes: ' || replace(node_types, '>', ' > '), 'Advice: ' || suggestion)) AS brief_length
FROM noted"""


QUERIES = {
    "sql_templates": (sql_templates, SQL_TEMPLATES),
    "sql_template_stats": (sql_template_stats, SQL_TEMPLATE_STATS),
    "first_samples": (first_samples, FIRST_SAMPLES),
    "sql_issues": (sql_issues, SQL_ISSUES),
    "sql_advice": (sql_advice, SQL_ADVICE),
    "explain_picks": (explain_picks, EXPLAIN_PICKS),
    "explain_first": (explain_first, EXPLAIN_FIRST),
    "sql_shapes": (sql_shapes, SQL_SHAPES),
    "clipped_texts": (clipped_texts, CLIPPED_TEXTS),
    "mask_odd": (mask_odd, MASK_ODD),
    "issue_merge": (issue_merge, ISSUE_MERGE),
    "issue_attribution": (issue_attribution, ISSUE_ATTRIBUTION),
    "issue_view": (issue_view, ISSUE_VIEW),
    "mask_flat": (mask_flat, MASK_FLAT),
    "mask_nested": (mask_nested, MASK_NESTED),
    "request_urls": (request_urls, REQUEST_URLS),
    "plan_summary": (plan_summary, PLAN_SUMMARY),
    "issue_briefs": (issue_briefs, ISSUE_BRIEFS),
    "plan_notes": (plan_notes, PLAN_NOTES),
}
