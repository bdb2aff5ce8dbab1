"""Operators on small hand-written or random tables, beside a plain sequential computation."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators import fleet
from opslens.operators.budget import within_budget
from opslens.operators.digest import exception_digest, repeated_lines, throughput_labels
from opslens.operators.endpoints import (
    endpoint_deltas,
    endpoint_rows,
    endpoint_stats,
    merge_endpoints,
    tracked,
)
from opslens.operators.grouping import (
    SizeCut,
    expire_by_size,
    group_records,
    merge_groups,
    nth_smallest,
    table_stats,
)
from opslens.operators.ordering import (
    carry_forward,
    first_per_request,
    last_lines,
    top_per_group,
)
from opslens.operators.search import (
    error_spikes,
    grep_files,
    level_counts,
    line_matches,
    search_records,
    table_tail,
    view_rows,
)
from opslens.operators.sqltrack import (
    as_deltas,
    explain_candidates,
    issue_rows,
    issues_of,
    merge_issues,
    summarise_plans,
    template_stats,
)
from opslens.options import DEFAULTS, Options
from opslens.schemas import (
    LOG_LINE,
    LOG_RECORD,
    PLAN_DOC,
    QUERY_SAMPLE,
    TIMING_SAMPLE,
    upgrade_log_groups,
)

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def lines_df(spark, *lines, file="a.log"):
    return spark.createDataFrame([(file, 0, i, line) for i, line in enumerate(lines)], LOG_LINE)


# --- ordering -------------------------------------------------------------------------------


def test_top_per_group_is_exact_for_a_dominating_group(spark):
    data = [("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(500)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, v bigint").repartition(16)
    got = rows(top_per_group(df, ["k"], [F.desc("v")], 7, "rank"), "k", "rank")
    groups = defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    expected = [
        (k, v, n) for k in sorted(groups) for n, v in enumerate(sorted(groups[k], reverse=True)[:7], 1)
    ]
    assert got == expected


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(10**6).select((F.col("id") % 3).alias("file"), F.lit(0).alias("block"), F.col("id").alias("seq"))
    plan = last_lines(df, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward_equals_a_sequential_walk(spark, inclusive):
    rng = random.Random(2)
    data = [
        (f"f{f}", c, c * 10 + i, rng.choice([None, None, rng.randrange(100)]))
        for f in range(3) for c in range(8) for i in range(6)
    ]
    df = spark.createDataFrame(data, "k string, chunk bigint, seq bigint, v bigint").repartition(5)
    got = rows(carry_forward(df, ["k"], ["chunk"], "seq", "v", "out", inclusive), "k", "seq")
    expected, last = [], {}
    for k, c, s, v in sorted(data):
        before = last.get(k)
        if v is not None:
            last[k] = v
        expected.append((k, c, s, v, last.get(k) if inclusive else before))
    assert got == expected


def test_first_per_request(spark):
    data = [("big", i) for i in range(40)] + [("small", i) for i in range(3)]
    df = spark.createDataFrame(data, "request_id string, seq bigint")
    got = rows(first_per_request(df, 5), "request_id", "seq")
    assert got == [("big", i) for i in range(5)] + [("small", i) for i in range(3)]
    assert first_per_request(df, None) is df
    nameless = spark.createDataFrame([(None, i) for i in range(9)], "request_id string, seq bigint")
    assert rows(first_per_request(nameless, 2), "seq") == [(None, 0), (None, 1)]


def test_statistics_run_no_job_before_they_are_asked_for(spark):
    df = spark.createDataFrame([], QUERY_SAMPLE)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "building a query")
    try:
        issues_of(df)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# --- search ---------------------------------------------------------------------------------


def test_level_counts_count_marks_not_lines(spark):
    df = lines_df(spark, "a.ERROR: then b.CRITICAL: x", "a.WARNING: x", "a.INFO: x a.INFO: y", "a.ALERT: z")
    assert rows(level_counts(df)) == [("a.log", 2, 1, 2)]


def test_spike_looks_at_the_last_lines_only(spark):
    df = lines_df(spark, *["a.ERROR: x"] * 30, *["a.INFO: x"] * 481, *["a.CRITICAL: x"] * 0)
    assert rows(error_spikes(df)) == [("a.log", 19, False)]
    df = lines_df(spark, *["a.ERROR: x"] * 30, *["a.INFO: x"] * 480)
    assert rows(error_spikes(df)) == [("a.log", 20, True)]


def test_grep_files_limits(spark):
    df = lines_df(spark, *[f"hit {i}" for i in range(30)], file="a.log").unionByName(
        lines_df(spark, *[f"hit {i}" for i in range(30)], file="b.log")
    ).unionByName(lines_df(spark, "hit", file="c.log"))
    opts = Options(grep_limit_per_file=20, grep_limit_total=30)
    got = rows(grep_files(df, line_matches("hit"), ["b.log", "a.log"], opts))
    assert [(r[0], r[2]) for r in got] == [("a.log", i) for i in range(29, 9, -1)] + [
        ("b.log", i) for i in range(29, 19, -1)
    ]


def test_record_search_and_tail(spark):
    df = spark.createDataFrame(
        [(i, "app", "ERROR", f"msg {i}% done") for i in range(1, 21)],
        "id bigint, channel string, level_name string, message string",
    )
    assert [r[0] for r in rows(table_tail(df, limit=3))] == [20, 19, 18]
    assert [r[0] for r in rows(table_tail(df, after_id=5, limit=3))] == [8, 7, 6]
    assert search_records(df, level="error", search="msg 1_%").count() == 11
    assert search_records(df, search="msg 1_", wildcards=False).count() == 0
    assert search_records(df, search="7% d", wildcards=False).count() == 2


def test_view_rejects_other_columns(spark):
    with pytest.raises(ValueError):
        view_rows(spark.range(1), "issues", sort="id")


# --- digests --------------------------------------------------------------------------------


def test_exception_digest(spark):
    df = lines_df(
        spark,
        "x.ERROR: ZError: early one",
        "[2024-01-01 10:00:00] a.ERROR: [object] (App\\FooException(code: 1): row (1) lost at /a.php:1)",
        "#0 [object] (App\\FooException(code: 1): row (22) lost at /a.php:9)",
        "[2024-01-01 11:00:00] a.INFO: nothing",
        "#1 [object] (App\\FooException(code: 1): row (3) lost in /b.php:2)",
        "[2024-01-01T12:00:00+00:00] a.INFO: iso time",
        "y.CRITICAL: ZError: early one",
    )
    got = rows(exception_digest(df).drop("file"), "rank")
    assert got == [
        (1, "App\\FooException", "row (1) lost", 3, datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11)),
        (2, "ZError", "early one", 2, None, datetime(2024, 1, 1, 12)),
    ]
    legacy = rows(exception_digest(df, iso=False).drop("file"), "rank")
    assert legacy[1][5] == datetime(2024, 1, 1, 11)
    # The last three lines hold two exceptions; ties go to the one seen first.
    tail = rows(exception_digest(df, 3).drop("file"), "rank")
    assert [(r[1], r[3], r[4]) for r in tail] == [
        ("App\\FooException", 1, None), ("ZError", 1, datetime(2024, 1, 1, 12))
    ]


def test_repeated_lines(spark):
    lines = []
    for count, text in ((4, "b"), (7, "a"), (2, "c"), (1, "single")):
        lines += [f"[2024-01-01T00:00:0{i}+00:00] app.ERROR: {text}" for i in range(count)]
    lines += ["no  time", "no time", "", "   "]
    got = rows(repeated_lines(lines_df(spark, *lines)).drop("file"), "rank")
    assert [(r[1], r[4]) for r in got] == [
        ("app.ERROR: a", 7), ("app.ERROR: b", 4), ("app.ERROR: c", 2), ("no  time", 2)
    ]
    assert got[0][2:4] == ("ERROR", "app")
    assert got[0][5:] == ("2024-01-01T00:00:00+00:00", "2024-01-01T00:00:06+00:00")
    assert got[3][5:] == ("", "")


def test_throughput_labels(spark):
    lines = [f"[2024-01-0{d} 10:0{m}:00] x" for d in (1, 2) for m in range(3)] + ["plain", ""]
    got = rows(throughput_labels(lines_df(spark, *lines, "[2024-01-01 10:01:30] y")).drop("file"), "label")
    assert got == [("10:00", 2, 3, 8), ("10:01", 3, 3, 8), ("10:02", 2, 3, 8)]
    last = throughput_labels(lines_df(spark, *lines), opts=Options(throughput_minutes=1))
    assert rows(last.drop("file")) == [("10:02", 2, 2, 7)]


# --- grouping -------------------------------------------------------------------------------


def records_df(spark, *items):
    """(seconds, message, context) as ERROR records of one channel."""
    data = [
        ("a.log", 0, i, at(s), "app", 400, "ERROR", m, c, None, None, None)
        for i, (s, m, c) in enumerate(items)
    ]
    return spark.createDataFrame(data, LOG_RECORD)


def test_group_records(spark):
    got = group_records(records_df(spark, (0, "m", "1"), (2, "m", "3"), (2, "m", "tie"), (1, "m", ""))).collect()
    assert len(got) == 1
    g = got[0]
    assert (g.occurrences, g.first_seen, g.last_seen, g.context) == (4, at(0), at(2), "3")
    assert group_records(records_df(spark, *[(i, f"m{i}", None) for i in range(3)])).count() == 3
    assert group_records(records_df(spark)).count() == 0
    assert group_records(records_df(spark, *[(0, "same", None)] * 1000)).first().occurrences == 1000
    single = group_records(records_df(spark, (0, "m", None), (1, "m", None)), Options(grouping=False))
    assert [r.message_key for r in single.collect()] == [None, None]


def test_merge_groups(spark):
    first = group_records(records_df(spark, *[(10, "m", "old")] * 5)).withColumn("version", F.lit(1))
    late = group_records(records_df(spark, *[(5, "m", None)] * 3)).withColumn("version", F.lit(2))
    both = first.unionByName(late)
    by_time = merge_groups(both, "time").first()
    assert (by_time.occurrences, by_time.first_seen, by_time.last_seen, by_time.context) == (8, at(5), at(10), "old")
    arrived = merge_groups(both, "arrival").first()
    assert (arrived.occurrences, arrived.first_seen, arrived.last_seen, arrived.context) == (8, at(10), at(5), None)
    again = merge_groups(merge_groups(first, "arrival").unionByName(late), "arrival").first()
    assert again == arrived


def test_old_rows_are_upgraded(spark):
    old = group_records(records_df(spark, (3, "m", None))).drop("occurrences", "first_seen", "message_key")
    row = upgrade_log_groups(old).first()
    assert (row.occurrences, row.first_seen, row.message_key) == (1, at(3), None)


def test_size_cut():
    mb = 1024 * 1024
    # 70 MB over, and a fifth more: 84 MB in rows of 1,024 bytes.
    plan = SizeCut.plan(270 * mb, 270 * 1024, 200 * mb)
    assert plan.rows_to_delete == 84 * 1024
    assert SizeCut.plan(500 * mb, 10, 500 * mb).rows_to_delete == 0
    assert SizeCut.plan(1000 * mb, 10, 1).rows_to_delete == 9
    assert SizeCut.plan(1000 * mb, 0, 1).rows_to_delete == 0


@pytest.mark.parametrize("n", [1, 2, 77, 299, 300])
def test_nth_smallest(spark, n):
    ids = random.Random(3).sample(range(-(10**12), 10**12), 300)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert nth_smallest(df, "id", n, buckets=16) == sorted(ids)[n - 1]


def test_expire_by_size(spark):
    df = spark.range(1, 101)
    kept = expire_by_size(df, 1000, id="id", limit_bytes=900)
    assert kept.agg(F.min("id"), F.count("id")).first() == (13, 88)


def test_table_stats_of_nothing(spark):
    empty = group_records(records_df(spark))
    assert table_stats(empty, 7).first() == (0, 7, 0, 0)


# --- sql ------------------------------------------------------------------------------------


def samples_df(spark, *items):
    """(request, sql, params, ms, caller) in arrival order."""
    data = [
        (r, i, at(i), f"/{r}", sql, p, float(ms), caller) for i, (r, sql, p, ms, caller) in enumerate(items)
    ]
    return spark.createDataFrame(data, QUERY_SAMPLE)


@pytest.mark.parametrize("times, flagged", [(6, True), (5, False)])
def test_n1_is_strict(spark, times, flagged):
    df = samples_df(spark, *[("r", f"SELECT * FROM t WHERE id = {i}", f'{{"id":{i}}}', 1, "c") for i in range(times)])
    got = issues_of(df).collect()
    assert len(got) == flagged
    if flagged:
        assert (got[0].is_n1, got[0].is_slow, got[0].worst_n1, got[0].worst_slow_ms) == (True, False, 6, None)
        assert got[0].analysis.unique_params == 6 and not got[0].analysis.all_identical
        assert got[0].reason == "n1_distinct"


def test_slow_only(spark):
    got = issues_of(samples_df(spark, ("r", "SELECT 1", None, 50, "c"), ("r", "SELECT a", None, 10, "c"))).collect()
    assert [(g.is_n1, g.is_slow, g.worst_slow_ms, g.worst_n1) for g in got] == [(False, True, 50.0, None)]
    assert "up to 50 ms" in got[0].suggestion


def test_both_flags_count_the_total(spark):
    df = samples_df(spark, *[("r", "SELECT 1", "{}", ms, f"c{ms}") for ms in (20, 50, 50.04)])
    got = issues_of(df, Options(n1_threshold=2)).first()
    assert (got.is_n1, got.is_slow, got.worst_slow_ms, got.caller) == (True, True, 120.0, "c50")
    assert got.analysis.all_identical and got.analysis.same_params_max == 3
    assert got.analysis.avg_ms == 40.0


def test_samples_beyond_the_limit_do_not_count(spark):
    df = samples_df(spark, *[("r", "SELECT 1", "{}", 1, "c")] * 501)
    assert template_stats(df).first().executions == 500


def test_explains_per_request(spark):
    items = [("r", f"SELECT * FROM t{c}", None, 50, "c") for c in "abcde"] + [("r", "UPDATE t", None, 50, "c")]
    picked = explain_candidates(issues_of(samples_df(spark, *items)))
    assert sorted(r.template for r in picked.collect()) == [f"SELECT * FROM t{c}" for c in "abc"]


def test_issue_merge_equals_the_sequential_fold(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        slow = rng.choice([None, float(rng.randrange(6))])
        n1 = rng.choice([None, rng.randrange(6)])
        data.append((f"t{rng.randrange(25)}", i, slow, n1))
    issues = spark.createDataFrame(data, "template string, i int, worst_slow_ms double, worst_n1 bigint").select(
        "template",
        F.lpad(F.col("i").cast("string"), 5, "0").alias("request_id"),
        F.col("worst_n1").isNotNull().alias("is_n1"),
        F.col("worst_slow_ms").isNotNull().alias("is_slow"),
        F.lit(1).cast("bigint").alias("executions"),
        "worst_n1",
        "worst_slow_ms",
        F.col("i").cast("string").alias("caller"),
        F.lit("{}").alias("params_json"),
        F.lit("/").alias("url"),
        F.lit("r").alias("reason"),
        F.lit("s").alias("suggestion"),
        F.lit(None).cast(
            "struct<executions:bigint,unique_params:bigint,same_params_max:bigint,all_identical:boolean,"
            "avg_ms:double,min_ms:double,max_ms:double,total_ms:double>"
        ).alias("analysis"),
        F.lit(at(0)).alias("last_seen"),
    )
    deltas = as_deltas(issues)
    whole = merge_issues(deltas.withColumn("version", F.lit(0)))
    parts = None
    for v in range(4):
        part = merge_issues(
            deltas.where(F.floor(F.col("at.request_id").cast("int") / 100) == v).withColumn("version", F.lit(v))
        )
        parts = part if parts is None else parts.unionByName(part)

    expected = {}
    for template, i, slow, n1 in data:
        old = expected.get(template)
        if old is None:
            expected[template] = (slow, n1, str(i))
            continue
        beaten = (slow or 0) > (old[0] or 0) or (n1 or 0) > (old[1] or 0)
        best = [max((x for x in pair if x is not None), default=None) for pair in ((slow, old[0]), (n1, old[1]))]
        expected[template] = (*best, str(i) if beaten else old[2])
    for merged in (whole, merge_issues(parts)):
        got = {r.template: (r.worst_slow_ms, r.worst_n1, r.caller) for r in issue_rows(merged).collect()}
        assert got == expected


def test_plan_summary(spark):
    plan = (
        '[{"Plan": {"Node Type": "Limit", "Total Cost": 3.5, "Plan Rows": 4, "Plans": ['
        '{"Node Type": "Seq Scan", "Filter": "(a = \'x\')", "Plans": []},'
        '{"Node Type": "Index Only Scan", "Index Name": "ix", "Plans": [{"Node Type": "Seq Scan"}]}]}}]'
    )
    df = spark.createDataFrame([("a", plan), ("b", "[]"), ("c", None), ("d", '[{"Plan": {"Node Type": "Index Scan"}}]')], PLAN_DOC)
    got = {r.template: r for r in summarise_plans(df).collect()}
    assert set(got) == {"a", "d"}
    assert got["a"].node_types == ["Limit", "Seq Scan", "Index Only Scan"]
    assert (got["a"].indexes_used, got["a"].scan_type, got["a"].total_cost) == (["ix"], "other", 3.5)
    assert (got["d"].scan_type, got["d"].total_cost, got["d"].indexes_used) == ("index", None, [])


# --- endpoints ------------------------------------------------------------------------------


def timings_df(spark, *items):
    """(path, type, ms, status) in arrival order."""
    return spark.createDataFrame(
        [(p, t, float(ms), s, at(i), i) for i, (p, t, ms, s) in enumerate(items)], TIMING_SAMPLE
    )


def test_endpoint_stats(spark):
    df = timings_df(spark, ("/a/1", "http", 100, 200), ("/a/2?x", "http", 200, None), ("/a/3", "http", 50, 404))
    got = endpoint_stats(df).first()
    assert (got.path, got.ema_ms, got.min_ms, got.max_ms, got.requests) == ("/a/{id}", 150.0, 100.0, 200.0, 2)
    assert (got.last_status, got.last_seen) == (200, at(1))
    one = endpoint_stats(timings_df(spark, ("/x", "http", 120, 200))).first()
    assert (one.ema_ms, one.min_ms, one.max_ms, one.requests) == (120.0, 120.0, 120.0, 1)


def test_tracked(spark):
    df = timings_df(spark, ("/a", "http", 5, 200), ("/b", "http", 5, 500), ("/c", "http", 50, None),
                    ("d", "cli", 5, 500), ("e", "mq", 5, None))

    def paths(**options):
        return "".join(sorted(r.path.strip("/") for r in tracked(df, Options(**options)).collect()))

    assert paths() == "acde"
    assert paths(tracked_statuses=()) == "abcde"
    assert paths(track_cli=False, track_mq=False) == "ac"
    assert paths(slow_endpoint_ms=50.0) == "c"


def test_running_average_in_batches_equals_the_sequential_one(spark):
    rng = random.Random(5)
    items = [(f"/p{rng.randrange(3)}", "http", rng.random() * 1000, 200) for _ in range(600)]
    df = timings_df(spark, *items)
    expected = {}
    for path, _, ms, _ in items:
        expected[path] = (expected[path] + ms) / 2 if path in expected else ms
    parts = None
    for v in range(3):
        part = endpoint_deltas(df.where(F.floor(F.col("seq") / 200) == v)).withColumn("version", F.lit(v))
        parts = part if parts is None else parts.unionByName(part)
    folded = merge_endpoints(parts.where("version < 2")).unionByName(parts.where("version = 2"))
    for merged in (merge_endpoints(parts), merge_endpoints(folded)):
        got = {r.path: r.ema_ms for r in endpoint_rows(merged).collect()}
        assert got == pytest.approx(expected, rel=1e-12)


# --- fleet ----------------------------------------------------------------------------------


def test_cpu_usage(spark):
    data = [("a", at(s), (4, total, idle)) for s, total, idle in
            ((0, 100, 50), (60, 200, 100), (86_400, 300, 175), (86_460, 300, 175), (200_000, 50, 10), (200_060, 150, 200))]
    df = spark.createDataFrame(data, "instance_id string, collected_at timestamp, cpu struct<cores:int,total:bigint,idle:bigint>")
    assert [r[2] for r in rows(fleet.cpu_usage(df), "collected_at")] == [0.0, 50.0, 25.0, 0.0, 0.0, 0.0]


def test_latest_and_summary(spark):
    now = F.lit(at(2000))
    data = [("i2", "b", at(1990), 6.0, 60.0), ("i2", "b", at(1000), 1.0, 10.0), ("i1", "a", at(1800), 2.0, 95.0),
            ("i3", "c", at(100), 9.0, 99.0), ("i4", "d", at(300), 0.5, None)]
    df = spark.createDataFrame(data, "instance_id string, hostname string, collected_at timestamp, m1 double, mem_pct double")
    df = df.withColumn("load", F.struct("m1"))
    latest = fleet.latest_snapshots(df, now)
    assert [r.hostname for r in latest.collect()] == ["a", "b", "d"]
    s = fleet.fleet_summary(latest, now).first()
    assert (s.hosts, s.live, s.stale, s.offline, s.max_load, s.max_mem_pct, s.avg_mem_pct) == (3, 1, 1, 1, 6.0, 95.0, 51.7)
    assert (s.load_class, s.mem_class) == ("crit", "crit")
    none = fleet.fleet_summary(latest.where("false"), now).first()
    assert (none.hosts, none.max_load, none.avg_mem_pct, none.load_class) == (0, 0.0, 0.0, "ok")


def test_throttle(spark):
    rng = random.Random(6)
    data = [(f"h{h}", at(t)) for h in range(3) for t in sorted(rng.choices(range(5000), k=300))]
    df = spark.createDataFrame(data, "instance_id string, collected_at timestamp")
    expected, last = [], {}
    for h, t in sorted(data):
        if h not in last or t >= last[h] + timedelta(seconds=60):
            last[h] = t
            expected.append((h, t))
    assert rows(fleet.accepted_reports(df), "instance_id", "accepted_at") == expected


def test_percentages(spark):
    df = spark.sql(
        "SELECT named_struct('total', 200L, 'free', 50L, 'available', CAST(NULL AS BIGINT)) mem,"
        " named_struct('total', 0L, 'free', 0L) disk"
    )
    assert fleet.with_percentages(df).select("mem_pct", "disk_pct").first() == (75.0, 0.0)


# --- budget and options ---------------------------------------------------------------------


def test_budget_equals_the_sequential_walk(spark):
    rng = random.Random(7)
    data = [(f"r{r}", i, rng.randrange(1, 60)) for r in range(30) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(data, "request_id string, seq bigint, bytes bigint")
    kept, cut, state = [], set(), defaultdict(lambda: [0, 0])
    for r, i, b in sorted(data):
        n, total = state[r]
        if n < 6 and total < 150:
            state[r] = [n + 1, total + b]
            kept.append((r, i, b))
        else:
            cut.add(r)
    got = rows(within_budget(df, 6, 150), "request_id", "seq")
    assert got == [(r, i, b, r in cut) for r, i, b in kept]


@pytest.mark.parametrize("name", ["n1_threshold", "key_length", "report_interval_s", "retention_hours", "repeat_groups"])
def test_options_out_of_range_are_refused(name):
    with pytest.raises(ValueError):
        Options(**{name: 0})


def test_options_take_what_is_given():
    o = Options(report_interval_s=900, grep_limit_per_file=5_000, repeat_groups=None)
    assert (o.report_interval_s, o.grep_limit_per_file, o.repeat_groups) == (900, 5_000, None)
    assert Options.statuses_from_text(" 200, 404,x") == (200, 404)
    assert Options.statuses_from_text("") == ()


def test_limits_of_none_mean_all(spark):
    lines = lines_df(spark, *[f"[2024-01-01 00:00:00] app.ERROR: same {i % 300}" for i in range(1200)])
    assert repeated_lines(lines, opts=Options(repeat_groups=None)).count() == 300
    assert repeated_lines(lines).count() == 200
    every = Options(grep_limit_per_file=None, grep_limit_total=None)
    assert grep_files(lines, line_matches("same"), ["a.log"], every).count() == 1200


def test_endpoints_without_path_or_type_are_kept(spark):
    data = [("/a", "http", 1e18, None, 0), *[("/a", "http", 1.0, None, i) for i in range(1, 66)],
            (None, "http", 2.0, 200, 70), ("/b", None, 4.0, 404, 71), (None, "http", 4.0, None, 7000)]
    df = spark.createDataFrame(
        [(p, t, ms, s, at(i), i) for p, t, ms, s, i in data],
        "path string, type string, ms double, status int, ts timestamp, seq bigint",
    )
    found = {(r.path, r.type): r for r in endpoint_rows(merge_endpoints(endpoint_deltas(df).withColumn("version", F.lit(0)))).collect()}
    average = 1e18
    for _ in range(65):
        average = (average + 1.0) / 2
    assert found["/a", "http"].ema_ms == pytest.approx(average, rel=1e-12)
    assert (found[None, "http"].ema_ms, found[None, "http"].last_status, found[None, "http"].requests) == (3.0, 200, 2)
    assert found["/b", None].last_status == 404


def test_throttle_over_a_month_without_a_pause(spark):
    interval, days = 7, 30
    every = spark.range(days * 86_400).select(
        F.lit("web1").alias("instance_id"), F.timestamp_seconds(F.col("id") + 1_000_003).alias("collected_at")
    )
    few = spark.createDataFrame([("web2", s) for s in (0, 6, 7, 13, 86_399, 86_404, 86_406, 400_000)], "instance_id string, s bigint")
    reports = every.unionByName(few.select("instance_id", F.timestamp_seconds("s").alias("collected_at")))
    found = fleet.accepted_reports(reports, Options(report_interval_s=interval)).select("instance_id", F.unix_seconds("accepted_at").alias("s"))
    first = found.where("instance_id = 'web1'")
    assert first.agg(F.count("*"), F.min("s"), F.max("s"), F.count_if((F.col("s") - 1_000_003) % interval != 0)).first() == (
        -(-days * 86_400 // interval), 1_000_003, 1_000_003 + (days * 86_400 - 1) // interval * interval, 0)
    assert sorted(r.s for r in found.where("instance_id = 'web2'").collect()) == [0, 7, 86_399, 86_406, 400_000]
