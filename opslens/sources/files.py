"""Log directories as DataFrames: lines with a total order, and the file catalogue."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_lines(
    spark: SparkSession, path: str | Sequence[str], files: Sequence[str] | None = None
) -> DataFrame:
    """Every line of the ``*.log`` files under ``path``: file (its full path), block, seq, line.

    ``files`` names other files to read, in each of the folders that has them. (block, seq) orders the lines of a file: the start of the split a line was read from, then its
    position in the scan. It is attached right behind the scan; filter afterwards.
    """
    reader = spark.read.option("lineSep", "\n")
    names = "*.log" if files is None else "{" + ",".join(map(_literal, files)) + "}"
    scan = reader.option("pathGlobFilter", names).text(path if isinstance(path, str) else list(path))
    return scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def _literal(name: str) -> str:
    """A file name in which no character stands for others."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", name)


def catalogue(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """The log files under ``path``, newest first. Only file status is read, never contents."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(
            F.substring_index("path", "/", -1).alias("file_name"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified"),
            "path",
        )
        .orderBy(F.desc("modified"), F.asc("file_name"))
    )


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the data files under a table folder."""
    sizes = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .agg(F.coalesce(F.sum("length"), F.lit(0)))
    )
    return int(sizes.first()[0])
