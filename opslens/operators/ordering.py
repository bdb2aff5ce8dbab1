"""Order-dependent building blocks that stay exact and parallel when one group dominates."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

# A dominating group is ranked in this many slices before its final ranking.
SLICES = 64

# Rows per chunk when a carried value runs along a file: 2^20 consecutive sequence numbers.
CHUNK_BITS = 20


def last_known(value: str, order: Column) -> Column:
    """Aggregate: the last ``value`` that is not null (rows without an order do not take part)."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), order))


def first_largest(value: str, order: str) -> Column:
    """One number that is largest for the largest ``value`` (a bigint), of several for the one that comes
    first by ``order`` (a bigint). Of fixed width, so an aggregate over it needs no sorting."""
    wide = F.col(value).cast("decimal(38,0)") * F.lit(Decimal(2**64))
    return wide - F.coalesce(order, F.lit(2**63 - 1))


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int | None,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of every group under ``order``, which should be total (None: all rows).

    Each input split ships at most ``n`` rows per group. A group spread over very many splits is
    first ranked in slices (all rows of a split share one), so no task sees it whole.
    """
    if n is None:
        in_group = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(in_group)) if rank else df
    if not keys:
        out = df.orderBy(*order).limit(n)
        if rank:
            out = out.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
        return out
    sliced = df.withColumn("_slice", F.spark_partition_id() % F.lit(SLICES))
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    pruned = (
        sliced.withColumn("_rank", F.row_number().over(in_slice))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_slice")
    )
    in_group = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = pruned.withColumn(name, F.row_number().over(in_group)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def last_lines(df: DataFrame, n: int | None, file: str = "file") -> DataFrame:
    """Last ``n`` lines of every file in line order (None: all)."""
    return top_per_group(df, [file], [F.desc("block"), F.desc("seq")], n)


def first_per_request(
    df: DataFrame, n: int | None, request: str = "request_id", order: str = "seq"
) -> DataFrame:
    """First ``n`` samples of every request (None: all); samples without a request count as one.

    Each input split keeps at most ``n`` rows of a request before the one exchange, by request, which
    later groupings under the request reuse.
    """
    if n is None:
        return df
    first = F.row_number().over(Window.partitionBy(request).orderBy(order))
    return df.withColumn("_place", first).where(F.col("_place") <= n).drop("_place")


def with_chunk(df: DataFrame, seq: str = "seq", bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``chunk``: consecutive rows of a block, 2^bits sequence numbers at a time."""
    return df.withColumn("chunk", F.shiftright(F.col(seq), bits))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: str,
    value: str,
    out: str,
    inclusive: bool = True,
    keep: Column | None = None,
) -> DataFrame:
    """Last non-null ``value`` up to each row, in (chunk, order) order within ``keys``.

    A plain running window would put a whole key group in one task. Here the last value of every
    chunk is aggregated first (a partial aggregate, one small row per chunk), handed on from chunk
    to chunk, and then joins its chunk as a row ahead of the others, so the running window covers
    one chunk at a time. ``inclusive=False`` looks strictly before the row. ``keep`` marks the rows
    wanted back; others matter only while they hold a value.
    """
    edges = df.groupBy(*keys, *chunk).agg(
        last_known(value, F.col(order)).alias("_last")
    )
    along = (
        Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    handed = (
        edges.select(*keys, *chunk, F.last("_last", ignorenulls=True).over(along).alias(value))
        .where(F.col(value).isNotNull())
        .withColumn("_own", F.lit(0))
    )
    rows = df.withColumn("_own", F.lit(1))
    if keep is not None:
        rows = rows.withColumn("_keep", F.coalesce(keep, F.lit(False))).where(
            F.col("_keep") | F.col(value).isNotNull()
        )
    running = (
        Window.partitionBy(*keys, *chunk)
        .orderBy(F.asc("_own"), F.asc(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    carried = (
        rows.unionByName(handed, allowMissingColumns=True)
        .withColumn(out, F.last(value, ignorenulls=True).over(running))
        .where(F.col("_own") == 1)
    )
    if keep is not None:
        carried = carried.where("_keep").drop("_keep")
    return carried.drop("_own")


def carry_time(
    lines: DataFrame,
    time: str = "line_ts",
    out: str = "carried",
    keep: Column | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Carry the last time seen in a file to the lines after it (stack traces)."""
    return carry_forward(
        with_chunk(lines, bits=bits), ["file"], ["block", "chunk"], "seq", time, out, keep=keep
    ).drop("chunk")
