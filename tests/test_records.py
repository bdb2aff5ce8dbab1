"""Stored records: ids, what is new, dates, old schemas, counters, the encode sentinel."""

import os
from datetime import datetime, timedelta
from glob import glob

import pytest
from pyspark.sql import functions as F

from opslens.operators.grouping import as_single_rows
from opslens.operators.search import search_records, table_tail
from opslens.options import Options
from opslens.schemas import LOG_GROUP, LOG_LINE
from opslens.sources.records import PLACE_BITS, UNENCODABLE, RecordTable, encoded
from opslens.streaming.ingest import IngestCounters, group_table, wanted_records, write_groups

T0 = datetime(2024, 1, 1)


def line(hour, text="job failed", level="ERROR", channel="app"):
    ts = (T0 + timedelta(hours=hour)).strftime("%Y-%m-%dT%H:%M:%S.000001+00:00")
    return f'[{ts}] {channel}.{level}: {text} {hour} {{"n":{hour}}} []'


def lines(spark, *texts):
    return spark.createDataFrame([("a.log", 0, n, t) for n, t in enumerate(texts)], LOG_LINE)


def records(spark, hours, parts=3):
    return as_single_rows(wanted_records(lines(spark, *[line(h) for h in hours]))).repartition(parts)


@pytest.fixture
def table(tmp_path):
    return RecordTable(str(tmp_path / "records"))


def hours(rows):
    return sorted(round((r.last_seen - T0).total_seconds() // 3600) for r in rows.collect())


def test_ids_are_dense_and_rise_in_files(spark, table):
    for batch in range(3):
        table.append(records(spark, range(10 * batch, 10 * batch + 10 + batch), 4), batch)
    rows = table.read(spark)
    for batch in range(3):
        ids = sorted(r.id for r in rows.where(F.col("batch") == batch).collect())
        assert ids == [(batch << PLACE_BITS) + i for i in range(10 + batch)]
    one = {f: spark.read.parquet(f).agg(F.min("id"), F.max("id"), F.count("*")).first() for f in glob(f"{table.path}/*/*/*/*.parquet")}
    spans = sorted(tuple(span) for span in one.values())
    assert sum(n for *_, n in spans) == 33 and len(spans) > 3


def test_replayed_batch_replaces_itself(spark, table):
    table.append(records(spark, range(5)), 0)
    table.append(records(spark, range(5)), 0)
    assert table.read(spark).count() == 5


def test_tail_and_after_on_a_stored_table(spark, table):
    for batch in range(2):
        table.append(records(spark, range(6)), batch)
    rows = table.read(spark)
    newest = [r.id for r in table_tail(rows, limit=4).collect()]
    assert newest == [(1 << PLACE_BITS) + i for i in (5, 4, 3, 2)]
    after = [r.id for r in table_tail(rows, after_id=3, limit=4).collect()]
    assert after == [(1 << PLACE_BITS) + 1, 1 << PLACE_BITS, 5, 4]
    assert search_records(rows, search="failed 3").count() == 2
    plan = table_tail(rows, after_id=1 << PLACE_BITS)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id" in plan


def test_polls_see_every_row_once(spark, table):
    table.append(records(spark, range(3)), 0)
    first, seen = table.changes(spark, None)
    table.append(records(spark, range(3, 7)), 1)
    table.append(records(spark, range(7, 9)), 0, writer="other")
    second, seen = table.changes(spark, seen)
    third, seen = table.changes(spark, seen)
    assert (hours(first), hours(second), third.count()) == ([0, 1, 2], [3, 4, 5, 6, 7, 8], 0)


def test_unfinished_batch_is_not_read(spark, table):
    table.append(records(spark, range(3)), 0)
    table.append(records(spark, range(3)), 1)
    [mark] = glob(f"{table.path}/writer=direct/batch=1/_SUCCESS")
    os.rename(mark, mark + "-gone")
    assert table.read(spark).count() == 3


def test_retention_touches_expired_days_only(spark, table):
    table.append(records(spark, range(0, 72, 3), 1), 0)
    table.append(records(spark, range(24, 96, 5), 1), 1)
    files = lambda day: set(glob(f"{table.path}/*/*/day=2024-01-{day:02d}/*.parquet"))
    kept_before = {day: files(day) for day in (3, 4)}
    expired = table.expire(spark, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    every = sorted([*range(0, 72, 3), *range(24, 96, 5)])
    assert expired == sum(h < 36 for h in every)
    assert hours(table.read(spark)) == [h for h in every if h >= 36]
    assert files(1) == set() and {day: files(day) for day in (3, 4)} == kept_before
    assert table.expire(spark, F.lit("2024-01-02 12:00:00").cast("timestamp")) == 0
    assert table.expire(spark, F.lit("2030-01-01").cast("timestamp")) == len(every) - expired
    assert table.read(spark).count() == 0


def test_dates_prune_folders(spark, table):
    table.append(records(spark, range(0, 96, 4), 1), 0)
    plan = table.read(spark).where("day = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


OLD = [f.name for f in LOG_GROUP.fields if f.name not in ("message_key", "occurrences", "first_seen")]


def test_old_rows_are_upgraded_on_read(spark, tmp_path, table):
    """A batch stored before there were keys, counts and first times, beside a new one."""
    old = records(spark, range(4)).select(*OLD)
    old.withColumn("day", F.to_date("last_seen")).write.partitionBy("day").parquet(f"{table.path}/writer=old/batch=0")
    table.append(records(spark, range(4, 6)), 0)
    rows = table.read(spark).collect()
    assert len(rows) == 6 and all(r.occurrences == 1 and r.first_seen == r.last_seen for r in rows)
    assert sum(r.id is None for r in rows) == 4

    groups = group_table(str(tmp_path / "groups"))
    write_groups(lines(spark, *[line(h) for h in range(3)]), 0, groups)
    stored = spark.read.parquet(f"{groups.path}/rows/writer=direct/batch=0")
    stored.drop("occurrences", "first_seen").write.parquet(f"{groups.path}/rows/writer=old/batch=0")
    merged = groups.read(spark).collect()
    assert sum(r.occurrences for r in merged) == 3 + stored.count()
    assert all(r.first_seen is not None for r in merged)


def test_counters_add_up_to_the_lines(spark, tmp_path):
    texts = [line(1), line(2, level="DEBUG"), line(3, channel="web"), line(4, level="INFO", channel="web"), "", " \t", "no header", "[x] y"]
    counters, opts = IngestCounters(), Options(channels=("app",))
    table = group_table(str(tmp_path / "groups"))
    for batch in range(3):
        write_groups(lines(spark, *texts), batch, table, opts, counters=counters)
    assert counters == IngestCounters(lines=24, blank=6, rejected=6, below_level=6, other_channel=3, written=3)
    assert sum(r.occurrences for r in table.read(spark).collect()) == counters.written

    def broken(rows, batch):
        rows.count()
        raise OSError("disk full")

    table.write_batch = broken
    with pytest.raises(OSError):
        write_groups(lines(spark, *texts), 3, table, opts, counters=counters)
    assert (counters.lines, counters.failed, counters.written) == (32, 8, 3)
    parts = (counters.blank, counters.rejected, counters.below_level, counters.other_channel, counters.written, counters.failed)
    assert sum(parts) == counters.lines


def test_encode_sentinel(spark, table):
    texts = spark.createDataFrame([("{}", b"ok"), ("", b""), (None, b"\xff{")], "a string, b binary")
    found = texts.select(encoded(F.col("a")).alias("a"), encoded(F.col("b").cast("string")).alias("b")).collect()
    assert [tuple(r) for r in found] == [("{}", "ok"), (None, None), (None, UNENCODABLE)]
    broken = records(spark, range(2)).withColumn("context", F.expr("cast(x'ff7b' as string)"))
    table.append(broken, 0)
    assert {r.context for r in table.read(spark).collect()} == {UNENCODABLE}
