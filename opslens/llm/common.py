"""What several operators need: tables in the shared folder, exact lookups under skew, components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

# Keys that hold more than one row in HEAVY are at most HEAVY in number.
HEAVY = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A session on one machine that names none gets a
    temporary one; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="opslens-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, reduced: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut.

    What was ``reduced`` by grouping is written as a file per core instead of per shuffle partition.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    out = df.coalesce(spark.sparkContext.defaultParallelism) if reduced else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, *values: Column, reduced: bool = False) -> tuple[DataFrame, Row]:
    """What ``stored`` returns, and ``values`` aggregated over its rows by the job that writes them. Each
    further job and its plan would cost the driver memory, of which rounds of small jobs need most."""
    seen = Observation()
    out = stored(df.observe(seen, *values), name, reduced)
    return out, Row(**seen.get)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def order_id(column: Column | str) -> Column:
    """An id to compare by: null comes before every other."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("bigint"), F.lit(-(2**63)))


def lookup(rows: DataFrame, keyed: DataFrame, key: str, copies: str, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``keyed``, one row per ``key``, ``copies`` of which are in rows.

    The at most HEAVY keys with over one row in HEAVY are broadcast, so none of them meets in one
    task; the others are joined as usual. ``rows`` is read twice. Rows without a partner are left out.
    ``total`` is the sum of copies, if it is known.
    """
    if total is None:
        total = keyed.agg(F.sum(copies)).first()[0] or 0
    is_heavy = F.col(copies) * HEAVY > total
    heavy = F.broadcast(keyed.where(is_heavy).drop(copies))
    common = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti")
    return common.unionByName(rest.join(keyed.where(~is_heavy).drop(copies), key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), the smallest id of each.

    Alternating stars: every node links its larger neighbours to its smallest one, then the smaller
    ones, until each component is a star. Minima combine before the shuffle; a table is written per
    round, and only a row count and a checksum reach the driver.
    """
    state = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, now = measured(edges.distinct(), "edges", *state, reduced=True)
    seen = None
    while now != seen:
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select("b", F.least("a", "m").alias("a"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = down.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges, now = measured(small.unionByName(own).distinct(), "edges", *state, reduced=True)
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
