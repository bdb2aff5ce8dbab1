"""SQL samples to issues: templates, per-request statistics, N+1 and slow flags, merging, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clip, is_select, mask_params, number_text, params_fingerprint, sql_template
from ..options import DEFAULTS, Options
from .ordering import first_largest, first_per_request, last_known, top_per_group

# A slow SELECT is explained at most this often per request.
EXPLAINS_PER_REQUEST = 3


def templated(samples: DataFrame) -> DataFrame:
    """Samples with template, masked parameters and their fingerprint; times rounded to 0.1 ms.

    ``tenths`` is the same time as a whole number, so that sums do not depend on their order.
    """
    return samples.select(
        "request_id",
        "seq",
        "ts",
        "url",
        "caller",
        sql_template("sql").alias("template"),
        F.round(F.coalesce("ms", F.lit(0.0)), 1).alias("ms"),
        mask_params("params_json").alias("params_json"),
    ).withColumns(
        {
            "fingerprint": params_fingerprint("params_json"),
            "tenths": F.round(F.col("ms") * 10).cast("bigint"),
        }
    )


def half_up_mean(tenths: str, count: str) -> Column:
    """Mean of summed tenths, rounded half up to one decimal in whole-number arithmetic."""
    return F.floor((F.col(tenths) * 2 + F.col(count)) / (F.col(count) * 2)) / 10


def template_counts(samples: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Statistics per request and template over the request's first samples, all of fixed width, so that
    they are hashed and never sorted. ``worst_seq`` tells the first execution that took longest."""
    kept = templated(first_per_request(samples, opts.samples_per_request))
    per_set = kept.groupBy("request_id", "template", "fingerprint").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.sum("tenths").alias("tenths"),
        F.max_by("seq", first_largest("tenths", "seq")).alias("worst_seq"),
        F.max(first_largest("tenths", "seq")).alias("worst"),
        F.min("seq").alias("first_seq"),
        F.max("ts").alias("last_seen"),
    )
    return (
        per_set.groupBy("request_id", "template")
        .agg(
            F.sum("repeats").alias("executions"),
            F.count(F.lit(1)).alias("unique_params"),
            F.max("repeats").alias("same_params_max"),
            F.min("min_ms").alias("min_ms"),
            F.max("max_ms").alias("max_ms"),
            F.sum("tenths").alias("tenths"),
            F.max_by("worst_seq", "worst").alias("worst_seq"),
            F.min("first_seq").alias("first_seq"),
            F.max("last_seen").alias("last_seen"),
            # Part of the result, so that a filter on it does not reach the raw samples.
            F.bool_and(is_select("template")).alias("is_select"),
        )
        .select(
            "request_id",
            "template",
            "executions",
            "unique_params",
            "same_params_max",
            "min_ms",
            "max_ms",
            (F.col("tenths") / 10).alias("total_ms"),
            half_up_mean("tenths", "executions").alias("avg_ms"),
            "worst_seq",
            "first_seq",
            "last_seen",
            "is_select",
        )
    )


def with_worst(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """``template_counts`` with url, caller and masked parameters of the execution that took longest.

    These are read for the winners only, by their number in the request; of samples with one number any.
    """
    said = samples.select(
        F.col("request_id").alias("_request"), F.col("seq").alias("_seq"), "url", "caller", "params_json"
    )
    same = F.col("request_id").eqNullSafe(F.col("_request")) & F.col("worst_seq").eqNullSafe(F.col("_seq"))
    found = counts.join(said, same).drop("_request", "_seq", "worst_seq")
    found = found.dropDuplicates(["request_id", "template"])
    return found.withColumn("params_json", mask_params("params_json"))


def template_stats(samples: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Statistics per request and template over the request's first samples.

    Caller, url and parameters are those of the first execution that took longest.
    """
    return with_worst(template_counts(samples, opts), samples)


def analysis() -> Column:
    """Execution statistics of an issue as one struct."""
    return F.struct(
        F.col("executions"),
        F.col("unique_params"),
        F.col("same_params_max"),
        ((F.col("unique_params") == 1) & (F.col("executions") > 1)).alias("all_identical"),
        F.col("avg_ms"),
        F.col("min_ms"),
        F.col("max_ms"),
        F.col("total_ms"),
    )


def reason_code() -> Column:
    """Why a template was flagged, as a stable code."""
    n1 = (
        F.when(F.col("unique_params") == 1, "n1_identical")
        .when(F.col("same_params_max") > 1, "n1_partly_repeated")
        .otherwise("n1_distinct")
    )
    return F.concat_ws(
        "+",
        F.when(F.col("is_n1"), n1),
        F.when(F.col("is_slow"), F.when(F.col("is_n1"), "slow_total").otherwise("slow_single")),
    )


def advice() -> Column:
    """What to do about a flagged template, in words."""
    executions, unique = F.col("executions").cast("string"), F.col("unique_params").cast("string")
    average = number_text("avg_ms")
    n1 = (
        F.when(
            F.col("unique_params") == 1,
            F.concat(
                F.lit("Ran "), executions,
                F.lit(" times with the same parameters: keep the first result and reuse it."),
            ),
        )
        .when(
            F.col("same_params_max") > 1,
            F.concat(
                F.lit("Ran "), executions, F.lit(" times with "), unique,
                F.lit(" parameter sets, one of them "), F.col("same_params_max").cast("string"),
                F.lit(" times: cache the repeats and fetch the rest in one query."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Ran "), executions, F.lit(" times, each with other parameters"),
                F.lit(": fetch them together in one query over a list of keys."),
            )
        )
    )
    slow = F.when(
        F.col("is_n1"),
        F.concat(
            F.lit("All runs took "), number_text("total_ms"), F.lit(" ms, "), average,
            F.lit(" ms each: reduce their number before tuning the query."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Took up to "), number_text("max_ms"), F.lit(" ms, "), average,
            F.lit(" ms on average: look at its plan."),
        )
    )
    return F.concat_ws(" ", F.when(F.col("is_n1"), n1), F.when(F.col("is_slow"), slow))


def flagged(stats: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Templates run too often (more than the threshold) or too slowly in one request."""
    is_n1 = F.col("executions") > opts.n1_threshold
    is_slow = F.col("max_ms") > opts.slow_sql_ms
    return stats.where(is_n1 | is_slow).withColumns({"is_n1": is_n1, "is_slow": is_slow})


def find_issues(stats: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Issue rows of the ``template_stats`` that are ``flagged``."""
    worst_slow = F.when(F.col("is_n1"), F.col("total_ms")).otherwise(F.col("max_ms"))
    return flagged(stats, opts).select(
        "request_id",
        "first_seq",
        "template",
        "is_n1",
        "is_slow",
        "executions",
        F.when(F.col("is_n1"), F.col("executions")).alias("worst_n1"),
        F.when(F.col("is_slow"), worst_slow).alias("worst_slow_ms"),
        "caller",
        "params_json",
        "url",
        reason_code().alias("reason"),
        advice().alias("suggestion"),
        analysis().alias("analysis"),
        "last_seen",
        "is_select",
    )


def issues_of(samples: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    counts = flagged(template_counts(samples, opts), opts).drop("is_n1", "is_slow")
    return find_issues(with_worst(counts, samples), opts)


def explain_candidates(issues: DataFrame, n: int | None = EXPLAINS_PER_REQUEST) -> DataFrame:
    """Slow SELECT issues whose plan is worth reading: the first ``n`` of every request (None: all)."""
    slow = issues.where(F.col("is_slow") & F.col("is_select"))
    return top_per_group(slow, ["request_id"], [F.asc("first_seq"), F.asc("template")], n)


def as_deltas(issues: DataFrame) -> DataFrame:
    """Per-request issues in the shape the issue table merges.

    The table must name the caller of the last execution that broke a record. The last record is the
    later one of two rows: the first to reach the worst time and the first to reach the worst count;
    both travel along, so partial merges lose nothing.
    """
    at = F.struct(F.col("last_seen").alias("at"), F.col("request_id").alias("request_id"))
    seen = F.struct(at.alias("at"), "caller", "params_json", "url")
    return issues.select(
        "template",
        "is_n1",
        "is_slow",
        "executions",
        "worst_n1",
        "worst_slow_ms",
        "reason",
        "suggestion",
        "analysis",
        "last_seen",
        at.alias("at"),
        seen.alias("slow_by"),
        seen.alias("n1_by"),
    )


def merge_issues(deltas: DataFrame) -> DataFrame:
    """Fold issue rows (with ``version``) into one row per template.

    Flags are or-ed, worst values are maxima that ignore nulls, executions add up, advice and
    analysis are the latest that are not null.
    """
    order = F.struct("version", "at")
    worst_time = F.struct(
        F.negative(F.coalesce("worst_slow_ms", F.lit(0.0))), F.col("version"), F.col("slow_by.at")
    )
    worst_count = F.struct(
        F.negative(F.coalesce("worst_n1", F.lit(0))), F.col("version"), F.col("n1_by.at")
    )

    def latest(name: str) -> Column:
        return last_known(name, order).alias(name)

    return deltas.groupBy("template").agg(
        F.bool_or("is_n1").alias("is_n1"),
        F.bool_or("is_slow").alias("is_slow"),
        F.sum("executions").alias("executions"),
        F.max("worst_n1").alias("worst_n1"),
        F.max("worst_slow_ms").alias("worst_slow_ms"),
        latest("reason"),
        latest("suggestion"),
        latest("analysis"),
        F.max_by("last_seen", order).alias("last_seen"),
        F.max_by("at", order).alias("at"),
        F.min_by("slow_by", worst_time).alias("slow_by"),
        F.min_by("n1_by", worst_count).alias("n1_by"),
        F.max("version").alias("version"),
    )


def issue_rows(merged: DataFrame) -> DataFrame:
    """The issue table as it is read: caller, parameters and url of the last record breaker."""
    by = F.when(F.col("slow_by.at") >= F.col("n1_by.at"), F.col("slow_by")).otherwise(F.col("n1_by"))
    return merged.withColumn("by", by).select(
        clip("template", "template").alias("template"),
        "is_n1",
        "is_slow",
        "executions",
        "worst_n1",
        "worst_slow_ms",
        "by.caller",
        "by.params_json",
        "by.url",
        "reason",
        "suggestion",
        "analysis",
        "last_seen",
    )


def with_plan_note(issues: DataFrame, plans: DataFrame) -> DataFrame:
    """Issues joined to their plan summary, the advice extended by what the plan shows."""
    note = (
        F.when(
            F.col("plan.scan_type") == "seq_scan",
            F.concat(
                F.lit("The plan reads the whole table"),
                F.coalesce(F.concat(F.lit(" to test "), F.col("plan.filter_cond")), F.lit("")),
                F.lit(": an index may help."),
            ),
        )
        .when(
            (F.col("plan.scan_type") == "index") & (F.size("plan.indexes_used") > 0),
            F.concat(
                F.lit("The plan uses index "), F.array_join("plan.indexes_used", ", "), F.lit(".")
            ),
        )
    )
    summaries = plans.select("template", F.struct(*[c for c in plans.columns if c != "template"]).alias("plan"))
    return issues.join(summaries, "template", "left").withColumn(
        "suggestion", F.when(F.col("is_slow"), F.concat_ws(" ", "suggestion", note)).otherwise(F.col("suggestion"))
    )


def issue_brief(plan: bool = False) -> Column:
    """One text that describes an issue to a reader: sections without content are left out."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value.cast("string"))

    a = "analysis."
    flags = F.concat_ws(
        "; ",
        F.when(F.col("is_n1"), line("repeated per request: ", F.col("worst_n1"))),
        F.when(F.col("is_slow"), line("slow, ms: ", number_text("worst_slow_ms"))),
    )
    parts = [
        line("Template: ", F.col("template")),
        F.when(flags != "", line("Flags: ", flags)),
        line("Executions: ", F.col(a + "executions")),
        line("Parameter sets: ", F.col(a + "unique_params")),
        F.when(F.col(a + "all_identical"), F.lit("All parameters identical")),
        line("Total ms: ", number_text(a + "total_ms")),
        F.concat(
            F.lit("Average, least, most ms: "),
            F.concat_ws(", ", *[number_text(a + n) for n in ("avg_ms", "min_ms", "max_ms")]),
        ),
    ]
    if plan:
        parts += [
            line("Plan root: ", F.col("plan.node_type")),
            line("Scan: ", F.col("plan.scan_type")),
            line("Estimated cost: ", number_text("plan.total_cost")),
            line("Estimated rows: ", F.col("plan.plan_rows")),
            line("Index condition: ", F.col("plan.index_cond")),
            line("Filter: ", F.col("plan.filter_cond")),
            F.when(F.size("plan.indexes_used") > 0, line("Indexes: ", F.array_join("plan.indexes_used", ", "))),
            F.when(F.size("plan.node_types") > 0, line("Plan nodes: ", F.array_join("plan.node_types", " > "))),
        ]
    parts += [
        F.when(F.col("caller") != "", line("Caller: ", F.col("caller"))),
        F.when(F.col("suggestion") != "", line("Advice: ", F.col("suggestion"))),
    ]
    return F.concat_ws("\n", *parts)


def summarise_plans(plans: DataFrame) -> DataFrame:
    """Stored JSON plans to one summary row each: root node, scan type, node types, indexes.

    The lists keep the order of the tree from the root down, as the text of a plan names a node
    before its children.
    """

    def root(name: str) -> Column:
        return F.get_json_object("plan_json", f"$[0].Plan['{name}']")

    def all_of(name: str) -> Column:
        pattern = rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"'
        return F.array_distinct(F.regexp_extract_all("plan_json", F.lit(pattern), F.lit(1)))

    return plans.select(
        "template",
        root("Node Type").alias("node_type"),
        root("Total Cost").cast("double").alias("total_cost"),
        root("Startup Cost").cast("double").alias("startup_cost"),
        root("Plan Rows").cast("bigint").alias("plan_rows"),
        root("Index Name").alias("index_name"),
        root("Index Cond").alias("index_cond"),
        root("Filter").alias("filter_cond"),
        scan_type(root("Node Type")).alias("scan_type"),
        all_of("Node Type").alias("node_types"),
        all_of("Index Name").alias("indexes_used"),
    ).where(F.col("node_type").isNotNull() | F.col("total_cost").isNotNull())


def scan_type(node_type: Column) -> Column:
    return (
        F.when(node_type.contains("Index"), "index")
        .when(node_type == "Seq Scan", "seq_scan")
        .otherwise("other")
    )
