"""Lines to grouped records, continuously."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.levels import code_of
from ..functions.loglines import RECORD_HEADER, parse_records, resolve_origin
from ..functions.text import trim_blanks
from ..operators.grouping import as_single_rows, group_records, merge_groups
from ..operators.search import at_least, in_channels
from ..options import DEFAULTS, Options
from ..schemas import LOG_GROUP, upgrade_log_groups
from ..sources.records import RecordTable
from ..sources.tables import MergedTable

# Batches written between two rewrites of the merged table.
COMPACT_EVERY = 50


def group_table(path: str, by: str = "time") -> MergedTable:
    upgrade = lambda rows: upgrade_log_groups(rows, "version")
    return MergedTable(path, LOG_GROUP, lambda rows: merge_groups(rows, by), upgrade)


@dataclass
class IngestCounters:
    """What became of the lines read so far: each counts in one of the other numbers.

    ``failed`` lines are those of batches whose write failed; such a batch comes again after a restart.
    """

    lines: int = 0
    blank: int = 0
    rejected: int = 0
    below_level: int = 0
    other_channel: int = 0
    written: int = 0
    failed: int = 0


def wanted_records(lines: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Parsed records of the wanted levels and channels."""
    return _wanted(parse_records(lines), opts)


def _wanted(records: DataFrame, opts: Options) -> DataFrame:
    return resolve_origin(in_channels(at_least(records, opts.min_level), opts.channels))


def counted_write(
    lines: DataFrame, opts: Options, counters: IngestCounters | None, write: Callable[[DataFrame], None]
) -> None:
    """``write`` the wanted records of a batch; ``counters`` learn from the same pass where lines went."""
    if counters is None:
        write(wanted_records(lines, opts))
        return
    seen, parsed = Observation("lines"), Observation("records")
    lines = lines.observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count_if(trim_blanks("line") == "").alias("blank")
    )
    low = F.col("level") < code_of(opts.min_level)
    other = ~low & (~F.col("channel").isin(*opts.channels) if opts.channels else F.lit(False))
    records = parse_records(lines).observe(
        parsed,
        F.count(F.lit(1)).alias("records"),
        F.count_if(low).alias("low"),
        F.count_if(other).alias("other"),
    )
    try:
        write(_wanted(records, opts))
    except Exception:
        counters.lines += (failed := lines.count())
        counters.failed += failed
        raise
    counters.lines += seen.get["lines"]
    counters.blank += seen.get["blank"]
    counters.rejected += seen.get["lines"] - seen.get["blank"] - parsed.get["records"]
    counters.below_level += parsed.get["low"]
    counters.other_channel += parsed.get["other"]
    counters.written += parsed.get["records"] - parsed.get["low"] - parsed.get["other"]


def write_groups(
    lines: DataFrame, batch: int, table: MergedTable, opts: Options = DEFAULTS,
    compact_every: int = COMPACT_EVERY, counters: IngestCounters | None = None,
) -> None:
    """One micro-batch: group its records and store them under the batch's number."""
    counted_write(lines, opts, counters, lambda rows: table.write_batch(group_records(rows, opts), batch))
    if compact_every and (batch + 1) % compact_every == 0:
        table.fold(lines.sparkSession)


def start_ingest(
    lines: DataFrame,
    table: MergedTable,
    checkpoint: str,
    opts: Options = DEFAULTS,
    immediate: bool = False,
    once: bool = False,
    counters: IngestCounters | None = None,
) -> StreamingQuery:
    """Stream lines into the grouped table.

    Batches follow the flush interval, or each other at once with ``immediate``. The checkpoint
    keeps the file positions; a batch repeated after a failure replaces its own rows.
    The observed metrics of ``query.lastProgress`` count the lines seen, those with text, and those that
    parsing rejects; ``counters`` add up where every line went.
    """
    counted = lines.observe(
        "ingest",
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.length("line") > 0).alias("filled_lines"),
        F.count_if(is_rejected()).alias("rejected_lines"),
    )
    writer = (
        counted.writeStream.option("checkpointLocation", checkpoint)
        .queryName("ingest")
        .foreachBatch(lambda batch, number: write_groups(batch, number, table, opts, counters=counters))
    )
    if once:
        writer = writer.trigger(availableNow=True)
    elif not immediate:
        writer = writer.trigger(processingTime=f"{opts.flush_ms} milliseconds")
    return writer.start()


def start_append(
    lines: DataFrame, path: str, checkpoint: str, opts: Options = DEFAULTS,
    counters: IngestCounters | None = None,
) -> StreamingQuery:
    """Stream lines into a ``RecordTable``: one row per record, with ids, by date."""
    table = RecordTable(path)

    def write(batch: DataFrame, number: int) -> None:
        counted_write(batch, opts, counters, lambda rows: table.append(as_single_rows(rows), number))

    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .queryName("append")
        .trigger(processingTime=f"{opts.flush_ms} milliseconds")
        .foreachBatch(write)
        .start()
    )


def is_rejected() -> Column:
    return (trim_blanks("line") != "") & ~F.col("line").rlike(RECORD_HEADER)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Non-empty lines that carry no record header: what parsing drops."""
    return lines.where(is_rejected())
