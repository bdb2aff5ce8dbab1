"""Host snapshots: latest state per instance, derived percentages, processes, report throttle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ..functions.levels import age_class, load_class, percent_class
from ..functions.text import clip
from ..options import DEFAULTS, Options
from .ordering import carry_forward

TICKS_PER_SECOND = 100
TOP_PROCESSES = 10
# Age of a snapshot that does not say when it was taken.
UNKNOWN_AGE_S = 9_999


def percent_used(total: Column, available: Column) -> Column:
    """Used share in percent, one decimal; 0 where the total is 0."""
    return F.when(total > 0, F.round((total - available) / total * 100, 1)).otherwise(F.lit(0.0))


def age_seconds(now: Column, collected_at: Column) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(collected_at)) / 1_000_000
    return F.coalesce(
        F.greatest(F.lit(0), F.round(age).cast("bigint")), F.lit(UNKNOWN_AGE_S)
    ).cast("bigint")


def with_percentages(snapshots: DataFrame) -> DataFrame:
    """Add used percentages of memory and disk; missing available memory falls back to free."""
    available = F.coalesce("mem.available", "mem.free", F.lit(0))
    return snapshots.withColumns(
        {
            "mem_pct": percent_used(F.coalesce("mem.total", F.lit(0)), available),
            "disk_pct": percent_used(
                F.coalesce("disk.total", F.lit(0)), F.coalesce("disk.free", F.lit(0))
            ),
        }
    )


def latest_snapshots(
    snapshots: DataFrame, now: Column, opts: Options = DEFAULTS
) -> DataFrame:
    """Newest snapshot of every instance that reported within the time to live."""
    fresh = snapshots.where(
        F.unix_micros(now) - F.unix_micros("collected_at") < opts.snapshot_ttl_s * 1_000_000
    )
    newest = fresh.groupBy("instance_id").agg(
        F.max_by(F.struct(*fresh.columns), "collected_at").alias("s")
    )
    return newest.select("s.*").orderBy("hostname", "instance_id")


def classify_hosts(snapshots: DataFrame, now: Column) -> DataFrame:
    """Age and severity class of every snapshot row; needs ``with_percentages``."""
    age = age_seconds(now, F.col("collected_at"))
    columns = {
        "age_s": age,
        "state": age_class(age),
        "load_class": load_class(F.col("load.m1")),
        "mem_class": percent_class("mem_pct"),
        "disk_class": percent_class("disk_pct"),
    }
    if "cpu_pct" in snapshots.columns:
        columns["cpu_class"] = percent_class("cpu_pct")
    return snapshots.withColumns(columns)


def fleet_summary(latest: DataFrame, now: Column) -> DataFrame:
    """One row over the latest snapshots: hosts by state, highest load and memory, average memory."""
    age = age_seconds(now, F.col("collected_at"))
    rows = latest.select(
        age_class(age).alias("state"), F.col("load.m1").alias("m1"), F.col("mem_pct")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.count_if(F.col("state") == "live").alias("live"),
        F.count_if(F.col("state") == "stale").alias("stale"),
        F.count_if(F.col("state") == "offline").alias("offline"),
        F.greatest(F.coalesce(F.max("m1"), F.lit(0.0)), F.lit(0.0)).alias("max_load"),
        F.greatest(F.coalesce(F.max("mem_pct"), F.lit(0.0)), F.lit(0.0)).alias("max_mem_pct"),
        F.coalesce(F.round(F.avg(F.coalesce("mem_pct", F.lit(0.0))), 1), F.lit(0.0)).alias("avg_mem_pct"),
    ).withColumns(
        {"load_class": load_class("max_load"), "mem_class": percent_class("max_mem_pct")}
    )


def cpu_usage(snapshots: DataFrame) -> DataFrame:
    """Cpu percentage of every snapshot since the one before it, from cumulative counters.

    Clamped to 0..100, one decimal; 0 without an earlier snapshot or without progress. Days are
    worked on in parallel, each taking over the last counters of the day before.
    """
    counters = F.struct(F.col("cpu.total").alias("total"), F.col("cpu.idle").alias("idle"))
    rows = snapshots.select(
        "instance_id",
        "collected_at",
        F.to_date("collected_at").alias("day"),
        counters.alias("counters"),
        # Snapshots of one time are ordered by their counters, which only grow.
        F.struct("collected_at", counters).alias("at"),
    )
    seen = carry_forward(rows, ["instance_id"], ["day"], "at", "counters", "before", inclusive=False)
    total = F.col("counters.total") - F.col("before.total")
    idle = F.col("counters.idle") - F.col("before.idle")
    busy = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1.0 - idle / total) * 100.0))
    return seen.select(
        "instance_id",
        "collected_at",
        F.when(total > 0, F.round(busy, 1)).otherwise(F.lit(0.0)).alias("cpu_pct"),
    )


def top_processes(snapshots: DataFrame, n: int = TOP_PROCESSES) -> DataFrame:
    """The busiest processes of every snapshot, one row each, by cpu share and then listed order.

    Processes are ranked inside the row they arrive in, so nothing is shuffled.
    """
    def measured(p: Column, i: Column) -> Column:
        life = F.col("uptime_s") - p["start_ticks"] / TICKS_PER_SECOND
        cpu = F.when(life > 0, p["ticks"] / TICKS_PER_SECOND / life * 100)
        mem = F.when(F.col("mem.total") > 0, p["rss_kb"] / F.col("mem.total") * 100).otherwise(0.0)
        command = F.coalesce(F.nullif(p["command"], F.lit("")), F.lit("[kernel]"))
        return F.struct(
            F.negative(F.round(cpu, 1)).alias("order"),
            i.alias("listed"),
            p["pid"].alias("pid"),
            p["user"].alias("user"),
            F.round(cpu, 1).alias("cpu"),
            F.round(mem, 1).alias("mem"),
            clip(F.trim(F.replace(command, F.lit("\x00"), F.lit(" "))), "command").alias("command"),
        )

    ranked = F.slice(
        F.array_sort(F.filter(F.transform("procs", measured), lambda p: p["cpu"].isNotNull())), 1, n
    )
    return snapshots.select("instance_id", "collected_at", F.posexplode(ranked).alias("rank", "p")).select(
        "instance_id",
        "collected_at",
        (F.col("rank") + 1).cast("int").alias("rank"),
        "p.pid",
        "p.user",
        "p.cpu",
        "p.mem",
        "p.command",
    )


# Reports are throttled within pieces of this many seconds.
PIECE_S = 86_400


def _through(times: np.ndarray, at: int, wait: int) -> list[int]:
    """From sorted seconds: the first from ``at`` on, then each first one ``wait`` or more later."""
    kept = []
    place = int(np.searchsorted(times, at))
    while place < len(times):
        kept.append(int(times[place]))
        place = int(np.searchsorted(times, times[place] + wait))
    return kept


@pandas_udf(ArrayType(LongType()))
def leaving(seconds: pd.Series, start: pd.Series, wait: pd.Series) -> pd.Series:
    """For each second a piece may be closed until, counted from its start: the second from which
    reports are taken again after it."""

    def ends(times: np.ndarray, begin: int, interval: int) -> list[int]:
        # The last accepted report follows from the first one: found from the end backwards.
        following = np.searchsorted(times, times + interval)
        free = np.empty(len(times) + 1, np.int64)
        free[len(times)] = -1
        for i in range(len(times) - 1, -1, -1):
            after = following[i]
            free[i] = times[i] + interval if after == len(times) else free[after]
        first = np.searchsorted(times, begin + np.arange(interval))
        return [int(free[p]) if p < len(times) else int(begin + e) for e, p in enumerate(first)]

    return pd.Series([ends(np.asarray(t), b, w) for t, b, w in zip(seconds, start, wait)])


@pandas_udf(ArrayType(LongType()))
def let_through(seconds: pd.Series, since: pd.Series, wait: pd.Series) -> pd.Series:
    return pd.Series([_through(np.asarray(t), s, w) for t, s, w in zip(seconds, since, wait)])


def accepted_reports(reports: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Reports let through by the throttle: one per instance and interval, counted from the last
    one accepted.

    Times count in whole seconds. A piece of an instance's time (a day, or the interval if that is
    longer) may be entered closed for up to an interval; where each of these cases leaves it is
    worked out per piece, then the cases are followed from piece to piece, and every piece lets
    through what its own case does. No task sees more than a piece of an instance, besides one short
    list per piece.
    """
    interval = opts.report_interval_s
    piece = max(PIECE_S, interval)
    seconds = reports.select(
        "instance_id", F.unix_seconds(F.col("collected_at").cast("timestamp")).alias("second")
    ).where(F.col("second").isNotNull())
    start = (F.floor(F.col("second") / piece) * piece).cast("bigint")
    pieces = (
        seconds.groupBy("instance_id", start.alias("start"))
        .agg(F.sort_array(F.collect_set("second")).alias("seconds"))
    )
    ends = pieces.select("instance_id", "start", leaving("seconds", "start", F.lit(interval)).alias("ends"))
    ordered = ends.groupBy("instance_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "ends"))).alias("pieces")
    )

    def follow(done: Column, step: Column) -> Column:
        closed = F.greatest(F.lit(0).cast("bigint"), done["free"] - step["start"])
        free = F.element_at(step["ends"], (closed + 1).cast("int"))
        entry = F.struct(step["start"].alias("start"), F.greatest(done["free"], step["start"]).alias("since"))
        return F.struct(free.alias("free"), F.array_append(done["entries"], entry).alias("entries"))

    begin = F.struct(
        F.lit(-(2**62)).cast("bigint").alias("free"),
        F.array().cast("array<struct<start:bigint,since:bigint>>").alias("entries"),
    )
    entries = ordered.select(
        "instance_id", F.inline(F.aggregate("pieces", begin, follow)["entries"])
    )
    same = [F.col("p.instance_id").eqNullSafe(F.col("e.instance_id")), F.col("p.start") == F.col("e.start")]
    kept = let_through("seconds", "since", F.lit(interval))
    return (
        pieces.alias("p")
        .join(entries.alias("e"), same)
        .select("p.instance_id", F.explode(kept).alias("second"))
        .select("instance_id", F.timestamp_seconds("second").alias("accepted_at"))
    )
