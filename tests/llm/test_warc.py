import gzip
import hashlib
import io

import pytest

from opslens.llm import warc
from opslens.llm.common import shared_path

BIG = "<p>größer</p>\r\n\r\n" * 80


def pages():
    return [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (9, "http://a/9", BIG), (None, "http://n", BIG),
        (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, "http://a\r\nX: y/5", None), (6, "", ""),
        (7, "http://a/7", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "http://a/8", "x" * 999), (10, "u", "x" * 999),
        (11, "u", "\0\x1f\x8b" * 400), (12, "u", "é" * 500), (13, "u", "é" * 500), (None, None, "none" * 300),
    ]


def expected(rows):
    keep = {}
    for page, _, body in rows:
        if len((body or "").encode()) >= 1000 and page is not None:
            keep[body] = max(keep.get(body, page), page)
    out = []
    for page, _, body in rows:
        data = (body or "").encode()
        other = keep.get(body) if len(data) >= 1000 else None
        revisit = other is not None and other != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    table = spark.createDataFrame([(*p, "clash", 1) for p in pages()], "page_id bigint, url string, html string, digest string, bytes int")
    found = warc.archived(table).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected(pages())
    assert {r.url for r in found if r.page_id == 5} == {"http://aX: y/5"}


def test_archives_are_bounded_in_bytes(spark, monkeypatch):
    """Pages of a megabyte go to archives of at most three; a page of five has one to itself."""
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 3 << 20)
    sizes = [1 << 20] * 7 + [5 << 20] + [1 << 19] * 9
    rows = [(n, "u", chr(97 + n) * size) for n, size in enumerate(sizes)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    raw, path = shared_path(spark, "raw"), shared_path(spark, "done")
    warc.write_raw(warc.decided(table, "page_id", "url", "html"), raw)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw).select("content").collect()
    lengths = [len(gzip.decompress(f.content)) for f in files]
    assert max(lengths) < (5 << 20) + 2000 and sum(x > (3 << 20) + 9000 for x in lengths) == 1 and len(files) <= 8
    warc.normalise(spark, raw, path)
    found = warc.read_archives(spark, path).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected(rows)
    assert len({r.archive for r in found}) == len(files)


def test_every_member_is_read_by_itself(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    raw, path = shared_path(spark, "raw"), shared_path(spark, "done")
    warc.write_raw(warc.decided(spark.createDataFrame(pages(), "page_id bigint, url string, html string").coalesce(1), "page_id", "url", "html"), raw)
    before = spark.read.format("binaryFile").load(raw).select("content").collect()
    assert len(before) >= 6 and all(b.content.count(b"\x1f\x8b\x08") == 1 for b in before)
    warc.normalise(spark, raw, path)
    after = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind=warc").collect()
    # Any gzip reader takes the new files, and they hold the same records.
    texts = lambda files: sorted(r for f in files for r in warc.records([gzip.decompress(f.content)]))
    assert texts(before) == texts(after)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(pages())
    for f in after:
        places = sorted((r.offset, r.length) for r in records if r.archive in f.path)
        assert places[0][0] == 0 and sum(n for _, n in places) == len(f.content)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_large_records_end_in_a_zero():
    for size in (0, 5, (1 << 24) + 3):
        packed = warc.member(b"x" * size)
        assert packed[-1] == 0
        assert gzip.GzipFile(fileobj=io.BytesIO(packed)).read() == b"x" * size


def test_inflating_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    text = bytes(range(256)) * 50
    assert b"".join(warc.inflated(gzip.compress(text))) == text
    assert b"".join(warc.inflated(gzip.compress(text) + b"\0\0" + gzip.compress(b"more"))) == text + b"more"
    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(text)[:-20]))


def test_broken_records_are_reported():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert list(warc.records([good[:5], good[5:] + good])) == [good, good]
    for bad in (good[:-1], good[:9], good.replace(b"2", b"3")):
        with pytest.raises(ValueError):
            list(warc.records([bad]))


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
