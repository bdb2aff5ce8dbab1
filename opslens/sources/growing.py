"""Files that are still being written: read what was appended since a byte offset.

Spark's own file stream takes each file once. This data source reads ``*.log`` files (or one glob
pattern) by byte range, as a batch from given offsets or from the end of the files, and as a stream
whose checkpoint is the map of file to byte position.

Options
    path            folder, file or ``folder/pattern``; looked up again for every micro-batch
    offsets         batch: JSON map of file name to first byte (missing: 0)
    ranges          batch: JSON map of file name to [first, end): lines that start within, of these files only
    tailBytes       batch: only this many bytes at the end of every file
    startingOffsets stream: ``earliest`` (default) or ``latest``
    maxBytesPerFile stream: most bytes of a file taken per micro-batch
    splitBytes      bytes read by one task (default 32 MiB)
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)
from pyspark.sql.types import StructType

from ..operators.search import grep
from ..options import DEFAULTS
from ..schemas import LOG_LINE

SPLIT_BYTES = 32 * 1024 * 1024
PROBE_BYTES = 64 * 1024
# A log line starts with its time, so that two files hardly begin alike.
BEGINNING_BYTES = 256
# End of a file that is searched unless all of it is asked for.
WINDOW_BYTES = 50 * 1024 * 1024


@dataclass(frozen=True)
class LogFile:
    path: str
    name: str
    size: int
    identity: str


@dataclass
class ByteRange(InputPartition):
    """Lines that start in [start, end). ``first`` marks the range a file is
    entered at: its first byte counts as the start of a line."""

    path: str
    name: str
    start: int
    end: int
    first: bool


def uri(path: str) -> str:
    """A growing file is followed where it is written: a path without a scheme is this machine's."""
    return path if "://" in path else f"file://{path}"


def list_files(path: str, rotated: bool = False) -> list[LogFile]:
    """The files a path, folder or pattern stands for right now. ``rotated``: the others of the folder
    whose name goes on behind the pattern, as that of a log put aside does.

    A file is known by its inode where there is one, else by its beginning (see ``beginning``)."""
    from pyarrow import fs

    filesystem, root = fs.FileSystem.from_uri(uri(path))
    if filesystem.get_file_info(root).type == fs.FileType.Directory:
        folder, pattern = root, "*.log"
    else:
        folder, _, pattern = root.rpartition("/")
    found = filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = (lambda n: fnmatch(n, f"{pattern}?*") and not fnmatch(n, pattern)) if rotated else (lambda n: fnmatch(n, pattern))
    files = [f for f in found if f.type == fs.FileType.File and names(f.base_name)]
    numbered = has_inodes(filesystem)
    return [
        LogFile(f.path, f.path, f.size, str(os.stat(f.path).st_ino) if numbered else beginning(path, f.path, f.size))
        for f in sorted(files, key=lambda f: f.path)
    ]


def has_inodes(filesystem) -> bool:
    from pyarrow import fs

    return isinstance(filesystem, fs.LocalFileSystem)


def beginning(base: str, path: str, size: int) -> str:
    """A file as known by its beginning: ``first:<n>:<hash of the first n bytes>``, n at most
    BEGINNING_BYTES; an empty file has none."""
    count = min(size, BEGINNING_BYTES)
    with _open(base, path) as handle:
        data = handle.read(count)
    return f"first:{len(data)}:{hashlib.md5(data).hexdigest()}" if data else ""


def same_file(base: str, known: str, file: LogFile) -> bool:
    """Whether a file is the one that was known: it may have grown since, also beyond the bytes its
    beginning was taken from."""
    if not known.startswith("first:"):
        return known == file.identity or known == "" and file.identity.startswith("first:")
    count = int(known.split(":")[1])
    return file.size >= count and (known == file.identity or known == beginning(base, file.path, count))


def _open(base: str, path: str):
    from pyarrow import fs

    filesystem, _ = fs.FileSystem.from_uri(uri(base))
    return filesystem.open_input_file(path)


def ranges(path: str, name: str, start: int, end: int, split: int) -> list[ByteRange]:
    return [
        ByteRange(path, name, at, min(at + split, end), at == start)
        for at in range(start, end, split)
    ]


def line_end(handle, position: int, size: int) -> int:
    """First byte behind the line that holds ``position``."""
    while position < size:
        handle.seek(position)
        data = handle.read(min(PROBE_BYTES, size - position))
        hit = data.find(b"\n")
        if hit >= 0:
            return position + hit + 1
        position += len(data)
    return size


def read_range(base: str, part: ByteRange) -> Iterator:
    """The lines of a range with their byte positions, as one Arrow batch."""
    import pyarrow as pa

    with _open(base, part.path) as handle:
        size = handle.size()
        start = part.start if part.first else line_end(handle, part.start - 1, size)
        end = line_end(handle, part.end - 1, size)
        if start >= min(end, part.end):
            return
        handle.seek(start)
        data = handle.read(end - start)
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    positions, at = [], start
    for line in lines:
        positions.append(at)
        at += len(line) + 1
    count = len(lines)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([part.name] * count, pa.string()),
            pa.array([part.start] * count, pa.int64()),
            pa.array(positions, pa.int64()),
            pa.array([line.decode("utf-8", "replace") for line in lines], pa.string()),
        ],
        names=["file", "block", "seq", "line"],
    )


class GrowingText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> StructType:
        return LOG_LINE

    def reader(self, schema: StructType) -> DataSourceReader:
        return OffsetReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


class OffsetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.offsets = json.loads(options.get("offsets", "{}"))
        self.tail = int(options.get("tailbytes", 0))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.ranges = json.loads(options.get("ranges", "null"))

    def partitions(self) -> list[InputPartition]:
        parts = []
        if self.ranges is not None:
            for path, (low, high) in sorted(self.ranges.items()):
                parts += [replace(r, first=r.start == 0) for r in ranges(path, path, low, high, self.split)]
            return parts or [ByteRange("", "", 0, 0, True)]
        for file in list_files(self.path):
            start = int(self.offsets.get(file.name, 0))
            if self.tail:
                start = max(start, file.size - self.tail)
            parts += ranges(file.path, file.name, start, file.size, self.split)
        return parts or [ByteRange("", "", 0, 0, True)]

    def read(self, partition: ByteRange) -> Iterator:
        if partition.path:
            yield from read_range(self.path, partition)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.latest = options.get("startingoffsets", "earliest") == "latest"
        self.most = int(options.get("maxbytesperfile", 0))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        self.seen = self._ends(None) if self.latest else {}
        return dict(self.seen)

    def latestOffset(self) -> dict:
        self.seen = {**self.seen, **self._ends(self.most or None)}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {**end, **self.seen}
        parts = []
        stayed = {p for p, (known, _) in start.items() if p in end and self._is(p, known, end[p][0])}
        moved = [entry for p, entry in start.items() if p not in stayed and entry[0]]
        for path, (identity, stop) in sorted(end.items()):
            # Positions go with the file, whatever its name is by now. A new file under the old name, or
            # a file cut short, is read from its beginning.
            before = [start[path]] if path in stayed else moved
            known = next((at for known, at in before if self._is(path, known, identity)), 0)
            begin = known if known <= stop else 0
            parts += ranges(path, path, begin, stop, self.split)
        return parts

    def _is(self, path: str, known: str, identity: str) -> bool:
        """Whether two identities are of the same file, which may have grown between them."""
        if known == identity or not (known.startswith("first:") and identity.startswith("first:")):
            return known == identity
        count = int(known.split(":")[1])
        return count < int(identity.split(":")[1]) and known == beginning(self.path, path, count)

    def read(self, partition: ByteRange) -> Iterator:
        yield from read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass

    def _ends(self, most: int | None) -> dict[str, list]:
        """Byte behind the last complete line of every file; a line still being written waits. A file
        that was put aside under another name is read to its end, last line included."""
        ends, gone = {}, []
        for file in list_files(self.path):
            identity, known = self.seen.get(file.path, [file.identity, 0])
            if not same_file(self.path, identity, file):
                gone.append((identity, known))
                identity, known = file.identity, 0
            elif file.size < known:
                known = 0
            ends[file.path] = [identity or file.identity, self._complete(file, known, most)]
        gone += [(i, known) for path, (i, known) in self.seen.items() if path not in ends]
        if any(identity for identity, _ in gone):
            for file in list_files(self.path, rotated=True):
                for identity, known in gone:
                    if identity and known <= file.size and same_file(self.path, identity, file):
                        ends[file.path] = [identity, file.size]
        return ends

    def _complete(self, file: LogFile, known: int, most: int | None) -> int:
        stop = file.size
        if stop <= known:
            return known
        with _open(self.path, file.path) as handle:
            if most and known + most < stop:
                # At least one line per batch, however long.
                stop = line_end(handle, known + most, stop)
            at = stop
            while at > known:
                low = max(known, at - PROBE_BYTES)
                handle.seek(low)
                hit = handle.read(at - low).rfind(b"\n")
                if hit >= 0:
                    return low + hit + 1
                at = low
        return known


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingText)


def read_from(
    spark: SparkSession, path: str, offsets: dict[str, int] | None = None
) -> DataFrame:
    """Lines behind the given byte offset of every file, tagged with their file. Files, here and in
    the offsets, go by their full path."""
    register_source(spark)
    return spark.read.format("growing_text").option("offsets", json.dumps(offsets or {})).load(path)


def next_offsets(path: str, offsets: dict[str, int] | None = None) -> dict[str, int]:
    """Offsets to continue from: the size of every file, or the old offset if it is larger."""
    old = offsets or {}
    return {f.name: max(f.size, int(old.get(f.name, 0))) for f in list_files(path)}


def read_window(spark: SparkSession, path: str, tail_bytes: int | None) -> DataFrame:
    """Lines within the last bytes of every file; the bytes before them are not read."""
    register_source(spark)
    reader = spark.read.format("growing_text")
    if tail_bytes:
        reader = reader.option("tailBytes", tail_bytes)
    return reader.load(path)


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of the lines appended to the files under ``path``."""
    register_source(spark)
    return spark.readStream.format("growing_text").options(**options).load(path)


def grep_window(
    spark: SparkSession,
    path: str,
    predicate: Column,
    limit: int | None = DEFAULTS.grep_limit_per_file,
    tail_bytes: int | None = WINDOW_BYTES,
) -> DataFrame:
    """Last matching lines of every file within its last bytes (None: in all of it)."""
    return grep(read_window(spark, path, tail_bytes), predicate, limit)


def read_ranges(spark: SparkSession, path: str, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """The lines that start within a byte range of each file."""
    register_source(spark)
    return spark.read.format("growing_text").option("ranges", json.dumps(parts)).load(path)


def grep_newest(
    spark: SparkSession, path: str, predicate: Column, limit: int = DEFAULTS.grep_limit_per_file,
    block: int = PROBE_BYTES, most: int = WINDOW_BYTES,
) -> DataFrame:
    """Last ``limit`` matching lines of every file, exact, read from the end backwards.

    Each round reads one more block of every file that has too few matches yet, four times as long as
    the one before (at most ``most`` bytes), and stops at ``limit`` matches or at the file's beginning:
    what is read depends on how far back the matches lie, not on the size of the file. The driver sees
    one count per file and round; a round keeps at most ``limit`` lines per file.
    """
    missing = {f.name: limit for f in list_files(path)}
    upto = {f.name: f.size for f in list_files(path)}
    found = read_ranges(spark, path, {}).where(predicate)
    while missing:
        parts = {name: (max(0, upto[name] - block), upto[name]) for name in missing}
        hits = grep(read_ranges(spark, path, parts).where(predicate), F.lit(True), limit).persist()
        counts = dict(map(tuple, hits.groupBy("file").count().collect()))
        found = found.unionByName(hits)
        upto |= {name: low for name, (low, _) in parts.items()}
        left = {name: want - counts.get(name, 0) for name, want in missing.items()}
        missing = {name: want for name, want in left.items() if want > 0 and upto[name] > 0}
        block = min(4 * block, most)
    # A file's blocks are parts of one line order: positions are bytes.
    return grep(found.withColumn("block", F.lit(0).cast("bigint")), F.lit(True), limit)
