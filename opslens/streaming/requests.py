"""SQL issues found when a request ends, from a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.sqltrack import as_deltas, issues_of, merge_issues
from ..options import DEFAULTS, Options
from ..schemas import ISSUE_DELTA, QUERY_SAMPLE
from ..sources.tables import MergedTable

# Batches written between two folds.
FOLD_EVERY = 50

_FIELDS = ("seq", "at", "url", "sql", "params_json", "ms", "caller")
_SAMPLE = "seq bigint, at bigint, url string, sql string, params_json string, ms double, caller string"
_CLOSED = f"request_id string, {_SAMPLE}"

# Lists and timers as state need this store.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def issue_table(path: str) -> MergedTable:
    return MergedTable(path, ISSUE_DELTA, merge_issues)


class Collecting(StatefulProcessor):
    """Holds the samples of open requests, each once, and gives them out when the request ends.

    State: a list of samples, to which new ones are appended; the newest time; how many samples there
    are and the largest number among them. With a cap the list is written anew only where samples come
    out of order, so it costs time in proportion to its samples however many batches bring them.
    """

    def __init__(self, cap: int | None):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _SAMPLE)
        self.open = handle.getValueState("open", "active bigint, count bigint, last bigint")

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        active, count, last = self.open.get() if self.open.exists() else (0, 0, -(2**63))
        ended, new = False, []
        for batch in rows:
            active = max(active, int(batch["at"].max()))
            ended = ended or bool(batch["ended"].fillna(False).astype(bool).any())
            own = batch[batch["sql"].notna()][list(_FIELDS)].astype(object)
            new += own.where(own.notna(), None).itertuples(index=False, name=None)
        new.sort(key=lambda row: row[0])
        if self.cap is not None and count + len(new) > self.cap and new and new[0][0] < last:
            new = sorted([*self.held.get(), *new], key=lambda row: row[0])[: self.cap]
            self.held.clear()
            count = 0
        new = new if self.cap is None else new[: self.cap - count]
        if new:
            self.held.appendList(new)
            count, last = count + len(new), max(new[-1][0], last if count else new[-1][0])
        if ended or active // 1000 <= timerValues.getCurrentWatermarkInMs():
            yield from self._closed(key)
            return
        self.open.update((active, count, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(active // 1000)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        yield from self._closed(key)

    def _closed(self, key: tuple) -> Iterator[pd.DataFrame]:
        held = sorted(self.held.get(), key=lambda row: row[0]) if self.held.exists() else []
        self.held.clear()
        self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            yield pd.DataFrame([(key[0], *row) for row in held], columns=["request_id", *_FIELDS])

    def close(self) -> None:
        pass


def closed_requests(samples: DataFrame, opts: Options = DEFAULTS, idle_s: int = 60) -> DataFrame:
    """Stream of the samples of requests that have ended.

    A request ends with a marked sample, or when it has been silent for ``idle_s`` against the newest
    time seen; samples older than that are late and dropped. Until then its first samples, as many as
    count, are Spark's state under the request; without a cap (None) an open request's state grows with
    its samples. Samples without a time are left out. The session's state store becomes RocksDB.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = samples.where(F.col("ts").isNotNull()).withWatermark("ts", f"{idle_s} seconds")
    closed = (
        rows.withColumn("at", F.unix_micros("ts"))
        .groupBy("request_id")
        .transformWithStateInPandas(Collecting(opts.samples_per_request), _CLOSED, "append", "eventTime")
    )
    return closed.withColumn("ts", F.timestamp_micros("at")).select(*QUERY_SAMPLE.names)


def start_requests(
    samples: DataFrame,
    issues: MergedTable,
    checkpoint: str,
    opts: Options = DEFAULTS,
    idle_s: int = 60,
    once: bool = False,
) -> StreamingQuery:
    """Write the issues of ended requests, batch by batch; a repeated batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        issues.write_batch(as_deltas(issues_of(batch, opts)), number)
        if (number + 1) % FOLD_EVERY == 0:
            issues.fold(batch.sparkSession)

    writer = (
        closed_requests(samples, opts, idle_s)
        .writeStream.option("checkpointLocation", checkpoint)
        .queryName("requests")
        .foreachBatch(write)
    )
    trigger = {"availableNow": True} if once else {"processingTime": f"{opts.flush_ms} milliseconds"}
    return writer.trigger(**trigger).start()
