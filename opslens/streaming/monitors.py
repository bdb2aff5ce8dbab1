"""Live monitors: volume per minute, error spikes, report throttle, endpoint statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.loglines import SEVERE_LINE, carried_time
from ..operators.endpoints import (
    endpoint_deltas,
    merge_endpoints,
    tracked,
    with_path_templates,
)
from ..options import DEFAULTS, Options
from ..schemas import ENDPOINT_DELTA, FILE_SPIKE
from ..sources.tables import MergedTable

# Batches written between two folds.
FOLD_EVERY = 50


def minute_rates(lines: DataFrame, lateness: str = "2 minutes") -> DataFrame:
    """Lines per file and minute of their own time, as a stream; late lines count while the
    watermark allows."""
    return (
        lines.select("file", carried_time("line").alias("line_ts"))
        .where(F.col("line_ts").isNotNull())
        .withWatermark("line_ts", lateness)
        .groupBy(F.window("line_ts", "1 minute"), "file")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("file", F.col("window.start").alias("minute"), "lines")
    )


def spike_counts(lines: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Stream of severe lines among the last lines of every file that has grown: file, errors, spike.

    The state is one mark per line, of as many lines as count.
    """
    most, threshold = opts.spike_lines, opts.spike_threshold

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for batch in batches:
            new = sorted([*new, *zip(batch["block"], batch["seq"], batch["severe"])])
            new = new if most is None else new[-most:]
        marks = (state.get[0] if state.exists else "") + "".join("1" if s else "0" for _, _, s in new)
        marks = marks if most is None else marks[-most:]
        state.update((marks,))
        errors = marks.count("1")
        yield pd.DataFrame({"file": [key[0]], "errors": [errors], "spike": [errors >= threshold]})

    return (
        lines.select("file", "block", "seq", F.col("line").rlike(SEVERE_LINE).alias("severe"))
        .groupBy("file")
        .applyInPandasWithState(
            count,
            "file string, errors bigint, spike boolean",
            "marks string",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


def spike_table(path: str) -> MergedTable:
    """The newest count of every file."""

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("file").agg(
            F.max_by("errors", "version").alias("errors"),
            F.max_by("spike", "version").alias("spike"),
            F.max("version").alias("version"),
        )

    return MergedTable(path, FILE_SPIKE, newest)


def start_spikes(
    lines: DataFrame, table: MergedTable, checkpoint: str, opts: Options = DEFAULTS
) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        table.write_batch(batch, number)
        if (number + 1) % FOLD_EVERY == 0:
            table.fold(batch.sparkSession)

    return (
        spike_counts(lines, opts)
        .writeStream.option("checkpointLocation", checkpoint)
        .queryName("spikes")
        .outputMode("update")
        .trigger(processingTime="15 seconds")
        .foreachBatch(write)
        .start()
    )


def throttle_reports(reports: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Stream of the reports let through: one per instance and interval since the last accepted.

    Reports are taken in time order within a batch; the state is one second number per instance.
    """
    interval = opts.report_interval_s

    def accept(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        seconds = sorted({int(s) for batch in batches for s in batch["second"]})
        kept = []
        for second in seconds:
            if last is None or second >= last + interval:
                last = second
                kept.append(second)
        if last is not None:
            state.update((last,))
        if kept:
            yield pd.DataFrame({"instance_id": key[0], "second": kept})

    return (
        reports.select("instance_id", F.unix_seconds("collected_at").alias("second"))
        .groupBy("instance_id")
        .applyInPandasWithState(
            accept,
            "instance_id string, second bigint",
            "last bigint",
            "append",
            GroupStateTimeout.NoTimeout,
        )
        .select("instance_id", F.timestamp_seconds("second").alias("accepted_at"))
    )


def endpoint_table(path: str) -> MergedTable:
    return MergedTable(path, ENDPOINT_DELTA, merge_endpoints)


def write_endpoints(
    samples: DataFrame, batch: int, table: MergedTable, opts: Options = DEFAULTS, fold_every: int = FOLD_EVERY
) -> None:
    table.write_batch(endpoint_deltas(with_path_templates(tracked(samples, opts))), batch)
    if fold_every and (batch + 1) % fold_every == 0:
        table.fold(samples.sparkSession)


def start_endpoints(
    samples: DataFrame, table: MergedTable, checkpoint: str, opts: Options = DEFAULTS
) -> StreamingQuery:
    return (
        samples.writeStream.option("checkpointLocation", checkpoint)
        .queryName("endpoints")
        .trigger(processingTime=f"{opts.flush_ms} milliseconds")
        .foreachBatch(lambda batch, number: write_endpoints(batch, number, table, opts))
        .start()
    )
