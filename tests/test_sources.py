"""Line scans, the growing-file source and stored tables."""

import os
import time

import pytest
from pyspark.sql import functions as F

from opslens.functions.loglines import carried_time
from opslens.operators.ordering import carry_time, last_lines
from opslens.operators.search import grep, line_matches
from opslens.schemas import struct, LONG, STRING
from opslens.sources.files import catalogue, read_lines, stored_bytes
from opslens.sources import growing
from opslens.sources.growing import grep_window, next_offsets, read_from, read_window, register_source
from opslens.sources.tables import MergedTable


def write(folder, name, text, mode="w"):
    with open(folder / name, mode) as handle:
        handle.write(text)


def texts(df):
    return [r.line for r in df.orderBy("file", "block", "seq").collect()]


def test_lines_keep_file_order_over_many_splits(spark, tmp_path):
    for name, count in (("a.log", 5000), ("b.log", 3000), ("c.txt", 10)):
        write(tmp_path, name, "".join(f"{name} {i}\n" for i in range(count)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.select("block").distinct().count() > 5
        got = texts(df)
        assert got == [f"a.log {i}" for i in range(5000)] + [f"b.log {i}" for i in range(3000)]
        tail = texts(last_lines(df, 15))
        assert tail == [f"a.log {i}" for i in range(4985, 5000)] + [f"b.log {i}" for i in range(2985, 3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_carried_time_over_many_splits(spark, tmp_path):
    lines = [
        f"[2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}] head" if i % 37 == 0 else f"  trace {i}"
        for i in range(4000)
    ]
    write(tmp_path, "a.log", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        marked = read_lines(spark, str(tmp_path)).withColumn("line_ts", carried_time("line"))
        got = carry_time(marked).orderBy("block", "seq").select(F.unix_seconds("carried")).collect()
        base = got[0][0]
        assert [r[0] - base for r in got] == [i - i % 37 for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_of_equal_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b", "c{1}"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, "app.log", f"{folder} 1\n{folder} 2\n")
    write(tmp_path / "b", "x[1].txt", "odd\n")
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert sorted(r.line for r in last_lines(read_lines(spark, both), 1).collect()) == ["a 2", "b 2"]
    named = read_lines(spark, both, ["app.log", "x[1].txt"])
    assert sorted(r.line for r in named.collect()) == ["a 1", "a 2", "b 1", "b 2", "odd"]
    assert named.select("file").distinct().count() == 3


def test_grep_within_the_last_bytes(spark, tmp_path):
    write(tmp_path, "a.log", "".join(f"hit {i:04d}\n" for i in range(100)))
    found = grep_window(spark, str(tmp_path), line_matches("hit"), None, 45)
    assert sorted(r.line for r in found.collect()) == [f"hit {i:04d}" for i in range(95, 100)]
    assert grep_window(spark, str(tmp_path), line_matches("hit"), None, None).count() == 100
    assert grep_window(spark, str(tmp_path), line_matches("hit"), 3, None).count() == 3


def test_carriage_returns_stay(spark, tmp_path):
    with open(tmp_path / "a.log", "wb") as handle:
        handle.write(b"one\r\ntwo\rthree\n\n\xff\n")
    assert texts(read_lines(spark, str(tmp_path))) == ["one\r", "two\rthree", "", "�"]
    assert texts(read_from(spark, str(tmp_path))) == ["one\r", "two\rthree", "", "�"]


def test_catalogue(spark, tmp_path):
    for age, name in ((30, "old.log"), (10, "new.log"), (20, "mid.log"), (5, "skip.txt")):
        write(tmp_path, name, "x" * age)
        os.utime(tmp_path / name, (time.time() - age, time.time() - age))
    df = catalogue(spark, str(tmp_path))
    assert [(r.file_name, r.size_bytes) for r in df.collect()] == [("new.log", 10), ("mid.log", 20), ("old.log", 30)]
    scan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in scan.split("Relation")[0]


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_byte_ranges_lose_and_repeat_nothing(spark, tmp_path, split):
    register_source(spark)
    lines = ["", "a", "bb" * 30, "é" * 9, "", "c" * 100, "end"]
    write(tmp_path, "a.log", "\n".join(lines))
    df = spark.read.format("growing_text").option("splitBytes", split).load(str(tmp_path))
    got = df.orderBy("seq").collect()
    assert [r.line for r in got] == lines
    offsets, at = [], 0
    for line in lines:
        offsets.append(at)
        at += len(line.encode()) + 1
    assert [r.seq for r in got] == offsets


def test_reading_from_offsets(spark, tmp_path):
    write(tmp_path, "a.log", "one\ntwo\n")
    write(tmp_path, "b.log", "uno\n")
    assert texts(read_from(spark, str(tmp_path))) == ["one", "two", "uno"]
    offsets = next_offsets(str(tmp_path))
    a, b = str(tmp_path / "a.log"), str(tmp_path / "b.log")
    assert offsets == {a: 8, b: 4}
    assert texts(read_from(spark, str(tmp_path), offsets)) == []
    write(tmp_path, "a.log", "three\n", "a")
    assert [(r.file, r.line) for r in read_from(spark, str(tmp_path), offsets).collect()] == [(a, "three")]
    assert texts(read_from(spark, str(tmp_path), {a: 4, b: 100})) == ["two", "three"]
    assert next_offsets(str(tmp_path), {b: 100}) == {a: 14, b: 100}


def test_window_at_the_end_of_files(spark, tmp_path):
    write(tmp_path, "a.log", "".join(f"line {i:04d}\n" for i in range(1000)))
    assert texts(read_window(spark, str(tmp_path), 25)) == ["0997", "line 0998", "line 0999"]
    hits = grep(read_window(spark, str(tmp_path), 100), line_matches("[05]$"), 1)
    assert texts(hits) == ["line 0995"]
    assert read_window(spark, str(tmp_path), None).count() == 1000


def test_missing_folder_and_pattern(spark, tmp_path):
    assert read_from(spark, str(tmp_path / "none" / "*.log")).count() == 0
    write(tmp_path, "a.log", "x\n")
    write(tmp_path, "b.log", "y\n")
    assert texts(read_from(spark, str(tmp_path / "b*.log"))) == ["y"]


COUNTS = struct(key=STRING, n=LONG)


def sums(df):
    return df.groupBy("key").agg(F.sum("n").alias("n"), F.max("version").alias("version"))


def test_merged_table(spark, tmp_path):
    table = MergedTable(str(tmp_path / "t"), COUNTS, sums)

    def content():
        return {r.key: r.n for r in table.read(spark).collect()}

    def batch(*pairs):
        return spark.createDataFrame(list(pairs), "key string, n bigint")

    assert content() == {}
    table.write_batch(batch(("a", 1), ("b", 2)), 0)
    table.write_batch(batch(("a", 10)), 1)
    assert content() == {"a": 11, "b": 2}
    table.write_batch(batch(("a", 10)), 1)  # replayed
    assert content() == {"a": 11, "b": 2}
    table.fold(spark)
    assert (table.content(spark).batches, content()) == ((), {"a": 11, "b": 2})
    table.write_batch(batch(("a", 10)), 1)  # replayed after the fold
    assert content() == {"a": 11, "b": 2}
    table.write_batch(batch(("c", 5)), 2)
    assert content() == {"a": 11, "b": 2, "c": 5}
    table.keep(spark, lambda rows: rows.where("key <> 'a'"))
    assert content() == {"b": 2, "c": 5}
    table.write_batch(batch(("b", 1)), 3)
    assert content() == {"b": 3, "c": 5}
    assert stored_bytes(spark, str(tmp_path / "t")) > 0
    table.clear(spark)
    assert content() == {}


def test_batches_of_another_checkpoint_count_beside_the_first(spark, tmp_path):
    table = MergedTable(str(tmp_path / "t"), COUNTS, sums)
    one = spark.createDataFrame([("a", 1)], "key string, n bigint")
    for writer in ("first", "second"):
        for number in range(3):
            table.write_batch(one, number, writer)
        assert table.read(spark).first().n == (3 if writer == "first" else 6)
        table.fold(spark)
    table.write_batch(one, 0, "third")
    assert table.read(spark).first().n == 7


def test_a_batch_written_meanwhile_is_neither_lost_nor_doubled(spark, tmp_path):
    table = MergedTable(str(tmp_path / "t"), COUNTS, sums)
    one = spark.createDataFrame([("a", 1)], "key string, n bigint")
    table.write_batch(one, 0)
    for number in range(1, 6):
        seen = table.content(spark)
        rows = table.read(spark, seen)
        table.write_batch(one, number)
        table.replace(rows, seen)
        assert table.read(spark).first().n == number + 1
    # What earlier folds took in is gone from the disk.
    assert len(list((tmp_path / "t" / "rows" / "writer=direct").glob("batch=*"))) <= 3
    assert len(list((tmp_path / "t" / "folds").glob("fold=*"))) <= 3


def test_unfinished_writes_are_ignored(spark, tmp_path):
    table = MergedTable(str(tmp_path / "t"), COUNTS, sums)
    table.write_batch(spark.createDataFrame([("a", 1)], "key string, n bigint"), 0)
    os.makedirs(tmp_path / "t" / "rows" / "writer=direct" / "batch=1")
    assert table.content(spark).batches == (("direct", 0),)


def big_log(path, count, hits):
    lines = [f"line {i} {'hit' if i in hits else 'no'} " + "x" * 80 for i in range(count)]
    path.write_text("\n".join(lines) + "\n")
    return lines


def test_newest_matches_are_read_from_the_end(spark, tmp_path, monkeypatch):
    """Bytes read do not grow with the file where the matches lie near its end; far ones are found too."""
    read = []

    def recorded(spark, path, parts, real=growing.read_ranges):
        read.append(sum(high - low for low, high in parts.values()))
        return real(spark, path, parts)

    monkeypatch.setattr(growing, "read_ranges", recorded)
    sizes = []
    for count in (20_000, 80_000):
        folder = tmp_path / str(count)
        folder.mkdir()
        lines = big_log(folder / "a.log", count, {count - 10 * k for k in range(1, 9)})
        read.clear()
        found = growing.grep_newest(spark, str(folder), line_matches("hit"), 5).orderBy("seq").collect()
        assert [r.line for r in found] == [x for x in lines if "hit" in x][-5:]
        sizes.append(sum(read))
    assert sizes == [growing.PROBE_BYTES] * 2


@pytest.mark.parametrize("hits", [{0}, {0, 1, 2, 700, 1_500, 2_998, 2_999}, set(), set(range(3_000))])
def test_newest_matches_like_a_full_search(spark, tmp_path, hits):
    big_log(tmp_path / "a.log", 3_000, hits)
    big_log(tmp_path / "b.log", 40, {3})
    (tmp_path / "empty.log").write_text("")
    for limit in (1, 4):
        got = growing.grep_newest(spark, str(tmp_path), line_matches("hit"), limit, block=1_000).collect()
        full = grep_window(spark, str(tmp_path), line_matches("hit"), limit, None).collect()
        assert sorted((r.file, r.seq, r.line) for r in got) == sorted((r.file, r.seq, r.line) for r in full)
