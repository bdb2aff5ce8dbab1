"""Keyed tables kept as parquet folders: one per batch of each writer, merged on read, folded on demand.

Layout: ``rows/writer=<w>/batch=<n>`` holds the rows of a writer's n-th batch; writing the batch again
replaces the folder. ``folds/fold=<k>`` holds the merge of everything before, and ``folded/fold=<k>``
the highest batch of every writer that is in it. The newest complete fold counts, together with all
batches beyond what it names. A folder is complete when Spark has left its ``_SUCCESS`` there.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

Merge = Callable[[DataFrame], DataFrame]


class Content(NamedTuple):
    """What a table consists of at one moment: its newest fold and the batches beyond it."""

    fold: int | None
    folded: dict[str, int]
    batches: tuple[tuple[str, int], ...]

    def upto(self) -> dict[str, int]:
        """Highest batch per writer that is in the content."""
        out = dict(self.folded)
        for writer, batch in self.batches:
            out[writer] = max(batch, out.get(writer, batch))
        return out


class MergedTable:
    """A table whose rows are the merge of every batch written to it.

    ``merge`` takes rows with a ``version`` column, which grows with the time of writing, and returns
    merged rows with one; it must give the same result however the batches are grouped. ``upgrade``
    fills what rows stored under an older schema lack, whenever rows are read.
    """

    def __init__(self, path: str, schema: StructType, merge: Merge, upgrade: Merge | None = None):
        self.path = path.rstrip("/")
        self.merge = merge if upgrade is None else lambda rows: merge(upgrade(rows))
        self.schema = StructType([f for f in schema.fields if f.name != "version"])

    def content(self, spark: SparkSession) -> Content:
        """One listing; whatever is computed from it can be published against it."""
        folds = sorted(int(name) for name in complete_folders(spark, f"{self.path}/folds", "fold"))
        folded: dict[str, int] = {}
        if folds:
            names = spark.read.schema("writer string, batch bigint")
            # One row per writer.
            folded = dict(map(tuple, names.parquet(f"{self.path}/folded/fold={folds[-1]}").collect()))
        batches = [
            (writer, int(batch))
            for writer in folders(spark, f"{self.path}/rows", "writer")
            for batch in complete_folders(spark, f"{self.path}/rows/writer={writer}", "batch")
        ]
        beyond = tuple(sorted(b for b in batches if b[1] > folded.get(b[0], -1)))
        return Content(folds[-1] if folds else None, folded, beyond)

    def write_batch(self, rows: DataFrame, batch: int, writer: str | None = None) -> None:
        """Store the rows of a batch. ``writer`` tells streams apart; within a stream's batch it is
        the stream's own id, which a new checkpoint changes."""
        writer = writer or stream_id(rows.sparkSession)
        self._write(rows, f"rows/writer={writer}/batch={batch}")

    def read(self, spark: SparkSession, content: Content | None = None) -> DataFrame:
        """The merged rows, each with the version of the last batch that touched it."""
        content = content or self.content(spark)
        reader = spark.read.schema(self._stored())
        paths = [f"{self.path}/rows/writer={w}/batch={b}" for w, b in content.batches]
        if content.fold is not None:
            paths.insert(0, f"{self.path}/folds/fold={content.fold}")
        return self.merge(reader.parquet(*paths) if paths else self._empty(spark))

    def fold(self, spark: SparkSession) -> None:
        """Merge what there is now into a new fold. Batches written meanwhile stay beyond it."""
        content = self.content(spark)
        if content.batches:
            self.replace(self.read(spark, content), content)

    def replace(self, rows: DataFrame, content: Content) -> None:
        """Publish ``rows``, computed from ``content``, in its place: after retention, for instance.

        Folders that the fold before had taken in are removed; those of ``content`` stay for readers
        that have begun.
        """
        spark = rows.sparkSession
        number = 0 if content.fold is None else content.fold + 1
        names = spark.createDataFrame(list(content.upto().items()), "writer string, batch bigint")
        names.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/fold={number}")
        self._write(rows, f"folds/fold={number}")
        for old in range(max(number - 3, 0), number - 1):
            remove(spark, f"{self.path}/folds/fold={old}")
            remove(spark, f"{self.path}/folded/fold={old}")
        for writer, upto in content.folded.items():
            for batch in folders(spark, f"{self.path}/rows/writer={writer}", "batch"):
                if int(batch) <= upto:
                    remove(spark, f"{self.path}/rows/writer={writer}/batch={batch}")

    def keep(self, spark: SparkSession, rule: Callable[[DataFrame], DataFrame]) -> None:
        """Apply a retention rule to the stored rows."""
        content = self.content(spark)
        self.replace(rule(self.read(spark, content)), content)

    def clear(self, spark: SparkSession) -> None:
        self.replace(self._empty(spark), self.content(spark))

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add("version", LongType())

    def _empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self._stored())

    def _write(self, rows: DataFrame, folder: str) -> None:
        if "version" not in rows.columns:
            rows = rows.withColumn("version", F.lit(time.time_ns() // 1000))
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._stored().fields]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{folder}")


def stream_id(spark: SparkSession) -> str:
    """Id of the stream whose batch is being written; it lives as long as its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def _path(spark: SparkSession, path: str):
    """The path and its file system, as Spark itself resolves them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the ``key=value`` folders under a path."""
    place, system = _path(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return [name.removeprefix(f"{key}=") for name in names if name.startswith(f"{key}=")]


def complete_folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Those of the folders whose write has finished."""
    out = []
    for name in folders(spark, path, key):
        mark, system = _path(spark, f"{path}/{key}={name}/_SUCCESS")
        if system.exists(mark):
            out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    place, system = _path(spark, path)
    system.delete(place, True)
