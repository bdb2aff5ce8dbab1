"""Exact dedup: rows grouped by a 128-bit hash of their normalised text, then compared byte by byte.

Grouping moves hashes only. The bytes are compared by grouping on hash and text: each split sends a
text once, however many copies of it the split holds, and a very common text meets in SLICES groups
first. Only where one hash turns out to stand for several texts are these told apart by the text.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import HEAVY, lookup, order_id, stored

WHITE = r"[\x20\x09-\x0D]+"
# Groups in which a very common text meets before it meets in one.
SLICES = 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _longest(n_chars: str, doc: str) -> Column:
    """Of two rows the larger one stays: more code points, then the smaller id (null before all)."""
    return F.col(n_chars).cast("decimal(38,0)") * F.lit(Decimal(2**64)) - order_id(doc)


def collisions(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Hashes that stand for several texts; ``texts`` (hash, norm), ``sizes`` (hash, n)."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = sizes.where(F.col("n") * HEAVY > total).select("hash", F.lit(True).alias("heavy"))
    dealt = texts.join(F.broadcast(heavy), "hash", "left")
    slice_of = F.when(F.col("heavy"), F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    met = dealt.withColumn("slice", slice_of).groupBy("hash", "slice", "norm").agg(F.count("*").alias("n"))
    # Slices of a very common hash are compared once more; of the others a count is enough.
    again = met.select("hash", F.when(F.col("slice").isNotNull(), F.col("norm")).alias("norm"))
    again = again.groupBy("hash", "norm").agg(F.count("*").alias("n"))
    variants = F.sum(F.when(F.col("norm").isNull(), F.col("n")).otherwise(1))
    return again.groupBy("hash").agg(variants.alias("variants")).where("variants > 1").select("hash")


def classes(docs: DataFrame, id_col: str, text_col: str, mark: Column, content_hash: Callable) -> DataFrame:
    """Per row: doc, mark, at (a number of the row), sha, n (rows of its class), keep (id of the row
    that stays), winner (its number)."""
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc"), mark.alias("mark"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"),
        norm.alias("norm"),
    ).withColumn("hash", content_hash(F.col("norm")))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("sha", F.sha2("norm", 256))
    slim = stored(rows.withColumn("key", F.col("hash")).drop("norm"), "hashes")
    sizes = stored(slim.groupBy("hash").agg(F.count("*").alias("n")), "sizes", True)
    collided = stored(collisions(rows.select("hash", "norm"), sizes), "collided", True)
    if not collided.isEmpty():
        apart = rows.join(collided.withColumn("collided", F.lit(True)), "hash", "left")
        text = F.when(F.col("collided"), F.col("norm")).otherwise("")
        slim = stored(apart.withColumn("key", F.concat("hash", text)).drop("norm", "collided"), "hashes")
    best = slim.withColumn("best", _longest("n_chars", "doc")).groupBy("key")
    best = best.agg(
        F.count("*").alias("n"),
        F.max_by("doc", "best").alias("keep"),
        F.max_by("at", "best").alias("winner"),
    )
    named = stored(best.withColumn("group_size", F.col("n")), "classes", True)
    return lookup(slim, named, "key", "n")


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable = F.md5
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Texts that differ in ASCII white space only are equal; null and empty texts are equal to each
    other. Of equal texts the one with the most code points stays, then the one with the smallest id;
    a null id comes before all others, and names a null keep_id. Of repeated rows exactly one stays.
    ``content_hash`` may be any hash: texts that it takes for equal are told apart by their bytes.
    Other columns are not read.
    """
    found = classes(docs, id_col, text_col, F.lit(0), content_hash)
    return found.select(
        F.col("doc").alias(id_col),
        F.col("keep").alias("keep_id"),
        "group_size",
        (F.col("at") == F.col("winner")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable = F.md5
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, chosen as in ``exact_copies``."""
    names = ("_copy_doc", "_copy_mark")
    marks = (order_id(id_col), F.xxhash64(*docs.columns))
    found = classes(docs, id_col, text_col, marks[1], content_hash).where("at = winner")
    chosen = stored(found.select(order_id("doc").alias(names[0]), F.col("mark").alias(names[1])), "chosen")
    kept = docs.withColumns(dict(zip(names, marks))).join(chosen, list(names), "left_semi")
    # Rows alike in id and all columns are one.
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    return kept.withColumn("_copy_rank", rank).where("_copy_rank = 1").select(*docs.columns)
