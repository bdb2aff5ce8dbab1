"""WARC: monolithic gzip archives made into archives of one member per record, with an offset index.

An archive compressed as one stream can be read only from its start. The normaliser inflates each
such file once, from front to back, writes every record as a gzip member of its own and a sidecar
index with the member's place, after which any record is read by itself.

All files are written and read by Spark, so they may lie in any store it knows. Its text writer ends
every row with a separator. Raw archives use the one that ends a WARC record. In normalised ones the
rows are gzip members without their last byte, which is zero, and the separator is that byte.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import shared_path, stored

MIN_REVISIT_BYTES = 1000
# An archive takes up to so many records and payload bytes; a larger payload has one to itself.
RECORDS_PER_FILE, BYTES_PER_FILE = 10_000, 128 << 20
# The tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes inflated, and bytes of members handed on, at a time.
PIECE = 1 << 20
BATCH = 8 << 20


def decided(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """page, url, body, bytes, digest, and the page whose payload stands for this one (else null)."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), body.alias("body"),
        F.octet_length(body).cast("bigint").alias("bytes"), F.sha1(body).alias("digest"),
    )
    # Only digests travel; a payload that occurs once needs no partner.
    keep = rows.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
        F.max("page").alias("keep"), F.count("*").alias("n")
    )
    keep = stored(keep.where("n > 1").drop("n"), "payloads", True)
    other = F.when(~F.col("page").eqNullSafe(F.col("keep")), F.col("keep"))
    return rows.join(keep, "digest", "left").withColumn("other", other).drop("keep")


def record_text(page: str, url: str, body: str, size: str, digest: str, other: str) -> Column:
    """A WARC record without the blank lines that end it."""
    revisit = F.col(other).isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col(size), F.lit(CRLF * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col(body)))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    kind = F.when(revisit, "revisit").otherwise("response")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", urn(page)),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\r\n]+", "")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col(digest))),
        field("WARC-Refers-To", urn(other)),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of the archive of this task they go to."""
    number = count = held = 0
    for batch in batches:
        numbers = []
        for size in batch.column("bytes").to_pylist():
            if count and (count == RECORDS_PER_FILE or held + size > BYTES_PER_FILE):
                number, count, held = number + 1, 0, 0
            count, held = count + 1, held + size
            numbers.append(number)
        yield batch.append_column("number", pa.array(numbers, pa.int32()))


def write_raw(rows: DataFrame, path: str) -> None:
    """Archives as one gzip stream each, at ``path``/number=N, filled one after the other by each task."""
    dealt = rows.mapInArrow(_dealt, StructType([*rows.schema.fields]).add("number", IntegerType()))
    text = record_text("page", "url", "body", "bytes", "digest", "other")
    writer = dealt.select(text.alias("value"), "number").write.option("lineSep", CRLF * 2)
    writer.option("compression", "gzip").partitionBy("number").text(path)


def inflated(content: bytes) -> Iterator[bytes]:
    """The text of a gzip file of one member or several, in pieces; zeros between them are skipped."""
    stream, at, data, begun = zlib.decompressobj(31), 0, b"", False
    while data or at < len(content):
        if not data:
            data, at = content[at : at + PIECE], at + PIECE
        begun = True
        yield stream.decompress(data, 4 * PIECE)
        data = stream.unconsumed_tail
        if stream.eof:
            data = stream.unused_data.lstrip(b"\0")
            stream, begun = zlib.decompressobj(31), False
    if begun:
        yield stream.flush()
        if not stream.eof:
            raise ValueError("an archive ends within its gzip stream")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with the blank lines that end them."""
    held, more = bytearray(), iter(pieces)

    def need(size: int) -> bool:
        while len(held) < size:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(held)
            if not need(seen + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record's header")
                return
        size = end + 4 + int(header(bytes(held[:end]))["content-length"]) + 4
        if not need(size) or held[size - 4 : size] != b"\r\n\r\n":
            raise ValueError("a record is not as long as its header says")
        yield bytes(held[:size])
        del held[:size]


def header(text: bytes) -> dict[str, str]:
    """Named fields, names in lower case."""
    lines = text.decode().split(CRLF)[1:]
    return {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}


def member(record: bytes) -> bytes:
    """A record as a gzip file whose last byte is zero.

    The last byte is the highest of the record's length; only records of 16 MB or more need an empty
    member after them.
    """
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


OUT = "kind string, archive string, seq bigint, value binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            *_, folder, name = path.split("/")
            archive = f"{name.split('.')[0]}-{folder.removeprefix('number=')}.warc.gz"
            rows, held, offset = [], 0, 0
            for seq, record in enumerate(records(inflated(content.as_py()))):
                packed = member(record)
                fields = header(record[: record.index(b"\r\n\r\n")])
                line = {
                    "offset": offset,
                    "length": len(packed),
                    "type": fields["warc-type"],
                    "id": fields.get("warc-record-id"),
                    "url": fields.get("warc-target-uri"),
                }
                rows.append(("warc", archive, seq, packed[:-1]))
                rows.append(("index", archive, seq, json.dumps(line).encode()))
                offset += len(packed)
                held += len(packed)
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def normalise(spark: SparkSession, raw: str, path: str) -> None:
    """Rewrite the archives under ``raw`` as ``path``/kind=warc/archive=NAME, with the index beside
    them under kind=index: one line per record (offset, length, type, id, url), ended by a zero byte.

    A file is one task's work from front to back, as its stream has no other entry.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", "*.gz").load(raw).select("path", "content")
    rows = files.mapInArrow(_normalise, OUT).sortWithinPartitions("kind", "archive", "seq")
    # The bytes of a member pass as a string that is never looked at.
    lines = rows.select(F.col("value").cast("string").alias("value"), "kind", "archive")
    lines.write.partitionBy("kind", "archive").option("lineSep", "\0").text(path)


RECORD = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, archive string, offset bigint, length bigint"
)


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def read_record(text: bytes) -> tuple:
    """What a record says of its page; the payload's digest is taken anew where it is there."""
    end = text.index(b"\r\n\r\n")
    fields = header(text[:end])
    block = text[end + 4 : end + 4 + int(fields["content-length"])]
    split = block.index(b"\r\n\r\n")
    http, payload = header(block[:split]), block[split + 4 :]
    size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != digest:
            raise ValueError("a payload does not have the digest of its record")
    page, other = _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to"))
    return page, size, digest, fields["warc-type"], other, fields.get("warc-target-uri")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of normalised archives, each inflated by itself from its place in the index."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=index")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # no records at all
        return spark.createDataFrame([], RECORD)
    index = spark.read.option("lineSep", "\0").text(f"{path}/kind=index")
    places = index.select(
        "archive", F.from_json("value", "offset bigint, length bigint").alias("p")
    ).select("archive", "p.*")
    name = F.regexp_extract("path", "archive=([^/]+)", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind=warc")
    files = files.select(F.url_decode(name).alias("archive"), "content")

    def read(archives: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        for archive in archives.to_pylist():
            content = memoryview(archive["content"])
            for p in own.to_pylist():
                text = zlib.decompressobj(31).decompress(content[p["offset"] : p["offset"] + p["length"]])
                rows.append((*read_record(text), archive["archive"], p["offset"], p["length"]))
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        fields = [c.split() for c in RECORD.split(", ")]
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(fields, columns)})

    return files.groupBy("archive").cogroup(places.groupBy("archive")).applyInArrow(read, RECORD)


def archived(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """Write ``pages`` to raw archives, normalise them and read them back: one row per row of pages.

    Of equal payloads of MIN_REVISIT_BYTES or more the one with the largest id is the response and
    the others revisit it; a row without an id revisits it too. Rows with that same id are responses
    as well. A null body is empty, a null url has no target.
    """
    spark = pages.sparkSession
    raw, path = shared_path(spark, "raw-archives"), shared_path(spark, "archives")
    write_raw(decided(pages, id_col, url_col, body_col), raw)
    normalise(spark, raw, path)
    return read_archives(spark, path)
