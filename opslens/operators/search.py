"""Filters, search and level counts over log lines and stored records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import code_of
from ..functions.loglines import LEVEL_HITS, SEVERE_LINE, basic_regex
from ..options import DEFAULTS, Options
from .ordering import last_lines


def at_least(records: DataFrame, level: str) -> DataFrame:
    """Records at or above a level; an unknown name lets everything pass."""
    return records.where(F.col("level") >= F.lit(code_of(level)))


def in_channels(records: DataFrame, channels: Sequence[str]) -> DataFrame:
    return records.where(F.col("channel").isin(*channels)) if channels else records


def non_empty(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("line") > 0)


def line_matches(pattern: str, literal: bool = False) -> Column:
    """Predicate of a grep run: a POSIX basic pattern, or plain text."""
    line = F.col("line")
    return line.contains(pattern) if literal else line.rlike(basic_regex(pattern))


def level_lines(level: str, exact: bool = True) -> Column:
    """Lines of one level; ``exact=False`` keeps the leading dot a wildcard."""
    return F.col("line").rlike(rf"{'[.]' if exact else '.'}{level.upper()}:")


def grep(
    lines: DataFrame, predicate: Column, limit: int | None = DEFAULTS.grep_limit_per_file
) -> DataFrame:
    """Last ``limit`` matching lines of every file (None: all)."""
    return last_lines(lines.where(predicate), limit)


def grep_files(
    lines: DataFrame, predicate: Column, files: Sequence[str], opts: Options = DEFAULTS
) -> DataFrame:
    """Search several files: per-file limit, then the last rows overall in the order of ``files``."""
    rank = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file"))
    hits = grep(
        lines.where(F.col("file").isin(*files)), predicate, opts.grep_limit_per_file
    ).withColumn("file_rank", rank)
    newest = [F.desc("file_rank"), F.desc("block"), F.desc("seq")]
    ordered = hits.orderBy(*newest)
    return ordered if opts.grep_limit_total is None else ordered.limit(opts.grep_limit_total)


def contains_any_case(lines: DataFrame, term: str) -> DataFrame:
    return lines.where(F.lower("line").contains(term.strip().lower()))


def match_counts(lines: DataFrame, predicate: Column) -> DataFrame:
    """Matching lines per file."""
    return lines.groupBy("file").agg(F.count_if(predicate).alias("matches"))


def level_counts(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Level marks per file; marks are counted, so one line may add several."""
    return lines.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.regexp_count("line", F.lit(p))), F.lit(0)).cast("bigint").alias(name)
            for name, p in LEVEL_HITS.items()
        ]
    )


def error_spikes(lines: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Severe lines among the last lines of every file, and whether they make a spike."""
    flags = lines.select(
        "file", "block", "seq", F.col("line").rlike(SEVERE_LINE).alias("severe")
    )
    return (
        last_lines(flags, opts.spike_lines)
        .groupBy("file")
        .agg(F.count_if("severe").alias("errors"))
        .withColumn("spike", F.col("errors") >= opts.spike_threshold)
    )


def search_records(
    records: DataFrame,
    level: str = "",
    channel: str = "",
    search: str = "",
    wildcards: bool = True,
) -> DataFrame:
    """Stored records by exact level, exact channel and message text.

    With ``wildcards`` the characters % and _ of the search text keep their LIKE meaning.
    """
    if level:
        records = records.where(F.col("level_name") == level.upper())
    if channel:
        records = records.where(F.col("channel") == channel)
    search = search.strip()
    if search:
        message = F.col("message")
        records = records.where(
            message.like(f"%{search}%") if wildcards else message.contains(search)
        )
    return records


def table_tail(
    records: DataFrame, after_id: int = 0, limit: int | None = DEFAULTS.table_tail_limit, id: str = "id"
) -> DataFrame:
    """Newest rows, or with ``after_id`` the oldest rows beyond it; always shown newest first."""
    if after_id > 0:
        records = records.where(F.col(id) > after_id)
        if limit is not None:
            records = records.orderBy(F.asc(id)).limit(limit)
        return records.orderBy(F.desc(id))
    newest = records.orderBy(F.desc(id))
    return newest if limit is None else newest.limit(limit)


# Columns a table view may be sorted by, and its default order.
SORTABLE = {
    "files": (("file_name", "size_bytes", "modified"), "modified"),
    "endpoints": (
        ("path", "type", "ema_ms", "min_ms", "max_ms", "requests", "last_seen", "last_status"),
        "ema_ms",
    ),
    "issues": (
        ("template", "executions", "worst_n1", "worst_slow_ms", "is_n1", "is_slow", "last_seen"),
        "last_seen",
    ),
}


def view_rows(
    df: DataFrame,
    view: str,
    equals: dict[str, object] | None = None,
    contains: dict[str, str] | None = None,
    sort: str | None = None,
    descending: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """A table view: equality and substring filters, one allowed sort column, an optional page.

    Ties are ordered by the other sortable columns, so that a page is the same on every call.
    """
    allowed, default = SORTABLE[view]
    sort = sort or default
    if sort not in allowed:
        raise ValueError(f"{view} cannot be sorted by {sort}")
    for name, wanted in (equals or {}).items():
        df = df.where(F.col(name) == F.lit(wanted))
    for name, text in (contains or {}).items():
        df = df.where(F.col(name).contains(text))
    ties = [F.asc(c) for c in allowed if c != sort and c in df.columns]
    ordered = df.orderBy(F.desc(sort) if descending else F.asc(sort), *ties)
    return ordered if limit is None else ordered.limit(limit)


