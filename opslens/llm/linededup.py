"""Line dedup: a sharded minimal perfect hash over the repeated lines, probed by the documents.

Lines are known by a 128-bit hash of their key. The keys found in two documents or more are dealt
over shards; each shard is one minimal perfect hash (levels of bit arrays with ranks) that numbers
its keys 0..n-1, and three arrays in that order: fingerprint, smallest document, number of documents.
Documents send the hashes of their lines to the shards' arrays and get line numbers back; no table
of lines is joined. A probe that was not among the keys meets another key's fingerprint and fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import byte_list, order_id, stored

MIN_CHARS = 10
# Keys per shard, and probes per group, aimed at.
SHARD_KEYS = 1 << 19
MIN_SHARDS = 8
GROUP_PROBES = 1 << 20
# Bits per key and level.
GAMMA = 2


def line_keys(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line whose key is long enough."""
    for number, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()  # bytes strip and fold ASCII only
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            yield number, key


LINE = "doc bigint, mark bigint, line int, first boolean, h1 bigint, h2 bigint"


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Per line with a long enough key: doc, mark, line number, whether it is the first with its key
    in the text, and the key's hash in two halves."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, first, hashes = [], [], [], []
            for row, text in enumerate(byte_list(batch.column("body"))):
                seen = set()
                for number, key in line_keys(text, min_chars):
                    digest = xxhash.xxh3_128_digest(key)
                    rows.append(row)
                    lines.append(number)
                    first.append(digest not in seen)
                    seen.add(digest)
                    hashes.append(digest)
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": batch.column("doc").take(row),
                    "mark": batch.column("mark").take(row),
                    "line": pa.array(lines, pa.int32()),
                    "first": pa.array(first, pa.bool_()),
                    "h1": np.ascontiguousarray(halves[:, 0]),
                    "h2": np.ascontiguousarray(halves[:, 1]),
                }
            )

    return docs.mapInArrow(keys, LINE)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64-bit hashes, one per level."""
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Each level has GAMMA bits per key left; a bit is set where exactly one key falls, the others go
    on to the next level. A key's number is the count of set bits before its own.
    """

    sizes: list[int]
    bits: np.ndarray  # all levels, one after the other

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = GAMMA * len(keys) + 1
            slot = mixed(keys, len(sizes)) % np.uint64(size)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[slot]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; for a key that was not built in any number, or -1."""
        rank = np.cumsum(self.bits) - 1
        found = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            found[left[hit]] = rank[at[hit]]
            left, start = left[~hit], start + size
        return found


SHARD = "shard int, seed bigint, sizes array<bigint>, bits binary, prints binary, least binary, docs binary"


def shard_keys(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit key for each 128-bit hash."""
    return mixed(h1.view(np.uint64), seed) ^ h2.view(np.uint64)


def build_shard(group: pa.Table) -> pa.Table:
    h1, h2, least, docs = (group.column(c).to_numpy() for c in ("h1", "h2", "least", "docs"))
    seed = 0
    # Two hashes may share a 64-bit key under one seed, once in a hundred million shards.
    while len(np.unique(keys := shard_keys(h1, h2, seed))) < len(keys):
        seed += 1
    table = PerfectHash.of(keys)
    order = np.argsort(table.numbers(keys))
    return pa.table(
        {
            "shard": group.column("shard").slice(0, 1).combine_chunks(),
            "seed": pa.array([seed], pa.int64()),
            "sizes": pa.array([table.sizes], pa.list_(pa.int64())),
            "bits": [np.packbits(table.bits).tobytes()],
            "prints": [h2[order].tobytes()],
            "least": [least[order].tobytes()],
            "docs": [docs[order].tobytes()],
        }
    )


def probe_shard(lines: pa.Table, shard: pa.Table) -> pa.Table:
    """The lines whose key is in the shard's arrays with a smaller document: (doc, mark, line)."""
    h1, h2, doc = (lines.column(c).to_numpy() for c in ("h1", "h2", "doc"))
    drop = np.zeros(len(h1), bool)
    if len(h1) and shard.num_rows:
        [own] = shard.to_pylist()
        packed = np.frombuffer(own["bits"], np.uint8)
        table = PerfectHash(own["sizes"], np.unpackbits(packed, count=sum(own["sizes"])).astype(bool))
        prints, least = np.frombuffer(own["prints"], np.int64), np.frombuffer(own["least"], np.int64)
        at = table.numbers(shard_keys(h1, h2, own["seed"]))
        drop = (at >= 0) & (prints[at] == h2) & (least[at] < doc)
    return lines.select(["doc", "mark", "line"]).filter(pa.array(drop))


@F.arrow_udf(StringType())
def without_lines(text: pa.Array, numbers: pa.Array) -> pa.Array:
    """The text without the lines of these numbers."""
    kept = [b"\n".join(kept_lines(t, n)) for t, n in zip(byte_list(text), numbers.to_pylist())]
    return pa.array(kept, pa.binary()).cast(pa.string())


DIGEST = StructType(
    [
        StructField("n_lines", LongType()),
        StructField("n_dropped", LongType()),
        StructField("kept_sha256", StringType()),
    ]
)


@F.arrow_udf(DIGEST)
def line_digest(text: pa.Array, numbers: pa.Array) -> pa.Array:
    rows = []
    for t, n in zip(byte_list(text), numbers.to_pylist()):
        kept, lines = kept_lines(t, n), t.count(b"\n") + 1
        rows.append((lines, lines - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    types = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "kept_sha256": pa.string()}
    arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types.values())]
    return pa.StructArray.from_arrays(arrays, list(types))


def kept_lines(text: bytes, numbers: list[int] | None) -> list[bytes]:
    drop = set(numbers or ())
    return [line for n, line in enumerate(text.split(b"\n")) if n not in drop]


def line_index(lines: DataFrame) -> tuple[DataFrame, Column]:
    """The index over the keys of several documents, one row per shard; and the shard of a line."""
    keys = lines.groupBy("h1", "h2").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), F.count_if("first").alias("docs")
    )
    keys = stored(keys.where("least < most").select("h1", "h2", "least", "docs"), "line-keys", True)
    shard = F.pmod("h1", F.lit(max(-(-keys.count() // SHARD_KEYS), MIN_SHARDS))).cast("int")
    return keys.withColumn("shard", shard).groupBy("shard").applyInArrow(build_shard, SHARD), shard


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """``docs`` with ``dropped_lines``: the numbers of the lines to drop, null where there are none.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of
    ``min_chars`` code points or more that several documents hold keep their lines in the one with
    the smallest id only. Null texts count as one empty line, a null id as smaller than all others;
    rows with the same id are one document. A column named dropped_lines is replaced.
    """
    names = ["_line_doc", "_line_mark"]
    # Rows with one id are told apart by their text; rows alike in both lose the same lines.
    tags = [order_id(id_col), F.xxhash64(text_col)]
    body = docs.select(tags[0].alias("doc"), tags[1].alias("mark"), F.col(text_col).alias("body"))
    lines = stored(hashed_lines(body, min_chars), "lines")
    index, shard = line_index(lines)
    index = stored(index, "line-index")
    # A shard with many probes, such as the one of a very common line, gets several copies of its
    # arrays; one row for half a million repeated keys can be broadcast.
    slices = lines.groupBy(shard.alias("shard")).agg(
        F.ceil(F.count("*") / GROUP_PROBES).cast("int").alias("slices")
    )
    slices = stored(slices, "line-slices", True)
    part = F.pmod(F.xxhash64("doc", "mark", "line"), F.col("slices")).cast("int")
    probes = lines.withColumn("shard", shard).join(F.broadcast(slices), "shard")
    probes = probes.select("doc", "mark", "line", "h1", "h2", "shard", part.alias("slice"))
    copies = index.join(F.broadcast(slices), "shard").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    group = ["shard", "slice"]
    hits = probes.groupBy(*group).cogroup(copies.drop("slices").groupBy(*group))
    hits = hits.applyInArrow(probe_shard, "doc bigint, mark bigint, line int")
    drops = hits.groupBy("doc", "mark").agg(F.collect_set("line").alias("dropped_lines"))
    drops = drops.select(*(F.col(c).alias(n) for c, n in zip(("doc", "mark"), names)), "dropped_lines")
    tagged = docs.drop("dropped_lines").withColumns(dict(zip(names, tags)))
    # The numbers are far smaller than the texts, which so need no sorting.
    return tagged.join(drops.hint("shuffle_hash"), names, "left").drop(*names)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_lines before dropping, n_dropped, kept_sha256 of what stays."""
    found = repeated_lines(docs.select(id_col, text_col), id_col, text_col)
    return found.select(id_col, line_digest(text_col, "dropped_lines").alias("d")).select(id_col, "d.*")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from the texts; no row is dropped, null stays null."""
    found = repeated_lines(docs, id_col, text_col)
    cut = F.when(F.col("dropped_lines").isNull(), F.col(text_col)).otherwise(
        without_lines(text_col, "dropped_lines")
    )
    return found.withColumn(text_col, cut).select(*docs.columns)
