"""Stored records: one row each, with ids, split by date; read by date, by id, or by what is new.

Layout: ``writer=<w>/batch=<n>/day=<d>``, plain partitioned Parquet. A batch written again replaces its
own folder. Within a batch ids are dense and lie in order in its files, so that the least and largest id
in a file's footer tell what a filter on ids may skip; dates are folders, which a filter on dates skips.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructType

from ..functions.text import empty_to_null
from ..schemas import LOG_GROUP, upgrade_log_groups
from .tables import complete_folders, folders, remove, stream_id

# An id is the batch's number, then the row's place within the batch: 2^40 rows to a batch.
PLACE_BITS = 40

# Fixed value: what stands for a value that cannot be encoded.
UNENCODABLE = '{"_serialization_error":"Failed to encode context/extra"}'

STORED = StructType([*LOG_GROUP.fields]).add("id", LongType())


def encoded(value: Column) -> Column:
    """Text as a JSON column holds it: null if empty, a sentinel if it is no valid UTF-8."""
    return empty_to_null(F.when(F.is_valid_utf8(value), value).when(value.isNotNull(), F.lit(UNENCODABLE)))


def with_ids(rows: DataFrame, batch: int) -> DataFrame:
    """``rows`` with ids of a batch: dense, rising with the rows' order in each partition.

    Partitions are counted and their sums handed on, one row per partition; the rows stay where they
    are. ``rows`` is read twice and must give the same partitions each time, as a batch of a stream does.
    """
    placed = rows.withColumns(
        {
            "_part": F.spark_partition_id(),
            "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_place") + F.lit(batch << PLACE_BITS)
    return placed.join(F.broadcast(starts), "_part").withColumn("id", place).drop("_part", "_place", "_start")


class Batches(NamedTuple):
    """The batches that a table holds at one moment."""

    complete: frozenset[tuple[str, int]]


class RecordTable:
    """Append-only records of the columns of ``LOG_GROUP``, with ``id``, ``writer``, ``batch``, ``day``.

    Ids are unique within a writer; a table with several orders by (id, writer). Batches written before
    there were ids, counts or first times are read with what those columns are by default.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def append(self, rows: DataFrame, batch: int, writer: str | None = None, date_of: str = "last_seen") -> None:
        """Store a batch; a batch of the same number and writer is replaced."""
        writer = writer or stream_id(rows.sparkSession)
        json = {c: encoded(F.col(c)) for c in ("context", "extra")}
        numbered = with_ids(rows.withColumns(json), batch).withColumn("day", F.to_date(date_of))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(
            f"{self.path}/writer={writer}/batch={batch}"
        )

    def content(self, spark: SparkSession) -> Batches:
        """The complete batches; two polls compare these to find what is new."""
        return Batches(
            frozenset(
                (writer, int(batch))
                for writer in folders(spark, self.path, "writer")
                for batch in complete_folders(spark, f"{self.path}/writer={writer}", "batch")
            )
        )

    def read(self, spark: SparkSession, since: Batches | None = None, content: Batches | None = None) -> DataFrame:
        """The rows of ``content`` (default: all complete batches) that were not there ``since``."""
        content = content or self.content(spark)
        new = sorted(content.complete - (since.complete if since else frozenset()))
        places = StructType().add("writer", StringType()).add("batch", LongType()).add("day", DateType())
        schema = StructType([*STORED.fields, *places.fields])
        if not new:
            return spark.createDataFrame([], schema)
        paths = [f"{self.path}/writer={writer}/batch={batch}" for writer, batch in new]
        rows = spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
        return upgrade_log_groups(rows, "id", "writer", "batch", "day")

    def changes(self, spark: SparkSession, since: Batches | None) -> tuple[DataFrame, Batches]:
        """What was written after ``since`` (None: everything), and the content to ask from next time."""
        content = self.content(spark)
        return self.read(spark, since, content), content

    def expire(self, spark: SparkSession, before: Column) -> int:
        """Drop rows last seen before ``before`` (a timestamp) and return their number.

        Of days before it only the times are read, and their folders go as a whole; of its own day the
        rows left are written anew. Files of later days are not touched. Rows without a date never
        expire.
        """
        content = self.content(spark)
        limit = spark.range(1).select(before.cast("timestamp").alias("at"), F.to_date(before).alias("day")).first()
        rows = self.read(spark, content=content)
        gone = F.col("last_seen") < F.lit(limit.at)
        # One row per writer, batch and day that is touched.
        touched = (
            rows.where(F.col("day") <= F.lit(limit.day))
            .groupBy("writer", "batch", "day")
            .agg(F.count_if(gone).alias("expired"), F.count(F.lit(1)).alias("rows"))
            .where("expired > 0")
            .collect()
        )
        if any(t.expired < t.rows for t in touched):
            left = rows.where((F.col("day") == F.lit(limit.day)) & ~gone)
            writer = left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("writer", "batch", "day").parquet(self.path)
        for t in touched:
            if t.expired == t.rows:
                remove(spark, f"{self.path}/writer={t.writer}/batch={t.batch}/day={t.day}")
        return sum(t.expired for t in touched)
