"""Benchmark decontamination: size-partitioned MinHash containment, verified by exact shingles.

A short test item is looked for inside long documents, so its containment counts, not the Jaccard
similarity, which a long document makes vanish: the MinHash values of the item are tested for
membership in the document. Items are partitioned by their number of shingles, and each partition
has its own sketch size: the bottom-k values, k large enough that a document with a share of
THRESHOLD of any item of the partition must hold one of them. No item is missed by chance. What the
sketches find is verified by counting the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .rolling import Prefixes

WORDS = 5
# Threshold as a fraction, so that the bounds are exact.
SHARE = (4, 5)
# Documents keep only shingles that pass a bitmap of the items' shingles, which has this fixed size
# whatever the number of items; more items make it less selective, never wrong.
FILTER_BITS = 1 << 23


def shingles(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lower-cased text with single blanks; starts, ends and hashes of its shingles.

    Words are runs of anything but ASCII white space. Under WORDS words there are none.
    """
    words = (text or "").lower().encode().split()
    none = np.zeros(0, np.int64)
    if len(words) < WORDS:
        return b"", none, none, none.astype(np.uint64)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], ends[:-WORDS] + 1])
    end = ends[WORDS - 1 :]
    return body, start, end, Prefixes(np.frombuffer(body, np.uint8)).of(start, end)


def in_filter(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(FILTER_BITS)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


SHINGLE = "{key}, n_shingles bigint, shingle string, hash bigint"


def shingled(df: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """One row per distinct shingle of a text, all of them or those that pass the bitmap.

    ``df`` has the columns of ``key`` and body. n_shingles counts all distinct ones.
    """
    names = [c.split()[0] for c in key.split(", ")]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, count, spelt, hashed = [], [], [], []
            for row, text in enumerate(batch.column("body").to_pylist()):
                body, start, end, own = shingles(text)
                hit = np.arange(len(own)) if bitmap is None else np.flatnonzero(in_filter(bitmap, own))
                if not len(hit):
                    continue
                distinct = len(np.unique(own))
                found = {body[start[i] : end[i]]: own[i] for i in hit.tolist()}
                rows += [row] * len(found)
                count += [distinct] * len(found)
                spelt += found.keys()
                hashed += found.values()
            take = pa.array(rows, pa.int64())
            columns = {n: batch.column(n).take(take) for n in names}
            columns["n_shingles"] = pa.array(count, pa.int64())
            columns["shingle"] = pa.array(spelt, pa.binary()).cast(pa.string())
            columns["hash"] = np.array(hashed, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(spell, SHINGLE.format(key=key))


def item_bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap over the hashes of all item shingles; at most FILTER_BITS / 64 rows are collected."""
    bit = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    # FILTER_BITS divides 2^64, so the signed remainder is the unsigned one.
    word = F.shiftright(bit, 6).alias("word")
    value = F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_BITS}) & 63 as int))").alias("value")
    rows = items.select(word, value).groupBy("word").agg(F.bit_or("value").alias("value")).collect()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for word, value in rows:
        bitmap[word] = value
    return bitmap.view(np.uint64)


def sketches(items: DataFrame) -> DataFrame:
    """``items`` with ``in_sketch``: whether a shingle is one of the bottom-k of its partition's size.

    Partition p holds the sizes over 2^(p-1) up to 2^p; the largest one sets k = size - needed + 1,
    so that of any size within, fewer than k shingles can be absent from a matching document.
    """
    share, whole = SHARE
    partition = F.ceil(F.log2(F.col("n_shingles")))
    most = F.pow(F.lit(2), partition).cast("bigint")
    k = most - F.ceil(most * share / whole) + 1
    rank = F.row_number().over(Window.partitionBy("item", "version").orderBy("hash", "shingle"))
    ranked = items.withColumns({"size_class": partition.cast("int"), "in_sketch": rank <= k})
    return ranked


def contained(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Pairs (id_col, item_col, n_common, n_shingles, containment): documents that hold at least
    SHARE of an item's distinct shingles, anywhere in their text.

    Items and documents of under WORDS words, null ones included, have no shingles and match nothing.
    Rows that agree in id and text count once. Rows of one id with different texts, in either table,
    are judged each, and the best match counts. A null id is an id like others.
    """
    share, whole = SHARE
    body = F.col(text_col)
    tests = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(body).alias("version"), body.alias("body"))
    tests = tests.dropDuplicates(["item", "version"])
    spelt = stored(sketches(shingled(tests, "item bigint, version bigint")), "item-shingles", True)
    bitmap = item_bitmap(spelt)
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body"))
    hits = shingled(texts, "doc bigint, mark bigint", bitmap)
    hits = stored(hits.select("doc", "mark", F.col("n_shingles").alias("doc_size"), "shingle"), "hits")
    own = spelt.select("item", "version", F.col("n_shingles").alias("size"), "shingle", "in_sketch")
    # Candidates by the sketches; a document with too few shingles for the item is none.
    fits = F.col("doc_size") * whole >= F.col("size") * share
    keys = ["doc", "mark", "item", "version"]
    candidates = hits.join(own.where("in_sketch"), "shingle").where(fits).select(*keys).distinct()
    candidates = stored(candidates, "candidates", True)
    # Only what the sketches found is verified, on the item's shingles themselves.
    items = own.drop("in_sketch").withColumnRenamed("item", "its_item").withColumnRenamed("version", "its_version")
    asked = candidates.join(items, F.col("item").eqNullSafe(F.col("its_item")) & (F.col("version") == F.col("its_version")))
    held = hits.select(F.col("doc").alias("its_doc"), F.col("mark").alias("its_mark"), F.col("shingle").alias("held"))
    same = F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("mark") == F.col("its_mark")) & (F.col("shingle") == F.col("held"))
    found = asked.join(held, same, "left_semi").groupBy(*keys, "size").agg(F.count("*").alias("n_common"))
    verified = found.where(F.col("n_common") * whole >= F.col("size") * share)
    match = F.struct((F.col("n_common") / F.col("size")).alias("containment"), "n_common", "size")
    best = verified.groupBy("doc", "item").agg(F.max(match).alias("m"))
    return best.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        "m.n_common",
        F.col("m.size").alias("n_shingles"),
        "m.containment",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item. All rows with the id of one that does go, too."""
    found = contained(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_leak")).distinct()
    found = stored(found, "leaks", True)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_leak")), "left_anti")
