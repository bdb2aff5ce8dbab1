"""SimHash near-duplicates: fingerprints linked by a self-join of their binary trie.

The trie of all distinct fingerprints is cut into subtrees ("blocks") of bounded size. Pairs of
blocks whose prefixes differ within the error budget are the node pairs of the trie's top; each is
one group, in which the traversal goes on: two nodes step down together, differing bits add up, and
a pair is dropped as soon as they exceed the budget.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from .common import byte_list, components, lookup, stored

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 2

# Blocks aimed at: one per BLOCK_SIZE fingerprints, within these limits. The upper one bounds what
# the driver knows of the trie: the counts of its nodes, never a fingerprint.
MIN_BLOCKS, MAX_BLOCKS, BLOCK_SIZE = 64, 4096, 1 << 18
# Shingles hashed, and node pairs held, at a time.
SHINGLE_BLOCK, FRONTIER = 1 << 16, 1 << 18
# Nodes this small are compared bit by bit at once.
LEAF = 4


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a lower-cased text, in blocks; a shorter text is one shingle."""
    words = text.lower().split()  # bytes split and fold ASCII only
    if not words:
        return
    count = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    for first in range(0, count, SHINGLE_BLOCK):
        part = words[first : min(first + SHINGLE_BLOCK, count) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        stops = ends[width - 1 :].tolist() or [len(joined)]
        yield np.array([digest(joined[i:j], seed) for i, j in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes) -> int:
    """64 bits, each set in more than half of the shingles' hashes, as a signed number."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text):
        total += len(hashes)
        for bit in range(64):
            counts[bit] += int(((hashes >> np.uint64(bit)) & np.uint64(1)).sum())
    value = sum(1 << bit for bit in range(64) if 2 * counts[bit] > total)
    return value - (value >> 63 << 64)


@F.arrow_udf(LongType())
def fingerprint_of(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in byte_list(text)], pa.int64())


def trie_blocks(fingerprints: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Disjoint subtrees (bits, prefix) of at most ``limit`` fingerprints that cover all of them.

    Node counts are taken eight levels at a time, below the nodes that are still too large only:
    these are at most rows / limit.
    """
    leaves, large, depth = [], [0], 0
    while large:
        below = fingerprints
        if depth:
            prefix = F.shiftrightunsigned("fp", 64 - depth)
            hot = fingerprints.sparkSession.createDataFrame([(p,) for p in large], "top bigint")
            below = fingerprints.join(F.broadcast(hot), prefix == F.col("top"), "left_semi")
        node = F.shiftrightunsigned("fp", 56 - depth) if depth < 56 else F.col("fp")
        tally = Counter()
        for key, n in below.groupBy(node.alias("node")).count().collect():
            key &= (1 << 64) - 1
            for bits in range(9):
                tally[depth + bits, key >> (8 - bits)] += n
        stack, large = [(depth, p) for p in large], []
        while stack:
            bits, prefix = stack.pop()
            if tally[bits, prefix] <= limit or bits == 64:
                leaves += [(bits, prefix)] if tally[bits, prefix] else []
            elif bits == depth + 8:
                large.append(prefix)
            else:
                stack += [(bits + 1, 2 * prefix), (bits + 1, 2 * prefix + 1)]
        depth += 8
    return sorted(leaves, key=lambda leaf: leaf[1] << (64 - leaf[0]))


def block_pairs(leaves: list[tuple[int, int]], budget: int = BUDGET) -> list[tuple[int, int]]:
    """Pairs of blocks that can hold near fingerprints, found by walking the top of the trie."""
    inner = {(bits - up, prefix >> up) for bits, prefix in leaves for up in range(bits + 1)}
    number = {leaf: i for i, leaf in enumerate(leaves)}
    found, stack = [], [((0, 0), (0, 0), 0)] if leaves else []

    def below(node: tuple[int, int]) -> list[tuple[int, int]]:
        bits, prefix = node
        kids = [node] * 2 if node in number else [(bits + 1, 2 * prefix), (bits + 1, 2 * prefix + 1)]
        return kids

    while stack:
        a, b, errors = stack.pop()
        if a in number and b in number:
            found.append((number[a], number[b]))
            continue
        if a == b:
            low, high = below(a)
            steps = [(low, low, errors), (high, high, errors), (low, high, errors + 1)]
        elif a in number or b in number:
            # One side is a block: the other goes down along the bits that both prefixes have.
            steps = [(x, y, errors) for x in set(below(a)) for y in set(below(b))]
        else:
            steps = [(x, y, errors + (i != j)) for i, x in enumerate(below(a)) for j, y in enumerate(below(b))]
        stack += [(x, y, e) for x, y, e in steps if e <= budget and x in inner and y in inner]
    return found


def near_pairs(
    left: np.ndarray, right: np.ndarray, budget: int = BUDGET
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in two sorted arrays of fingerprints that differ in at most ``budget`` bits.

    A node is a range of a sorted array. For an array joined with itself pass it twice; each pair
    comes once.
    """
    same = left is right
    root = [np.array([x], np.int64) for x in (0, len(left), 0, len(right), 0)]
    stack = [(0, root)] if len(left) and len(right) else []
    one = np.uint64(1)

    def halves(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        top = values[low] >> np.uint64(bit)
        cut = np.searchsorted(values, (top | one) << np.uint64(bit))
        return np.clip(cut, low, high)

    while stack:
        depth, nodes = stack.pop()
        while len(nodes[0]):
            if len(nodes[0]) > FRONTIER:
                half = len(nodes[0]) // 2
                stack.append((depth, [x[half:] for x in nodes]))
                nodes = [x[:half] for x in nodes]
            l0, l1, r0, r1, _ = nodes
            done = ((l1 - l0 <= LEAF) & (r1 - r0 <= LEAF)) | (depth == 64)
            if done.any():
                rows, cols = (l1 - l0)[done], (r1 - r0)[done]
                size = rows * cols
                owner = np.repeat(np.arange(len(size)), size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                i, j = l0[done][owner] + at // cols[owner], r0[done][owner] + at % cols[owner]
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                near &= (i < j) if same else True
                if near.any():
                    yield i[near], j[near]
                nodes = [x[~done] for x in nodes]
                if not len(nodes[0]):
                    break
            l0, l1, r0, r1, errors = nodes
            bit = 63 - depth
            lm, rm = halves(left, l0, l1, bit), halves(right, r0, r1, bit)
            kids = [(l0, lm, r0, rm, errors), (lm, l1, rm, r1, errors), (l0, lm, rm, r1, errors + 1)]
            crossed = (lm, l1, r0, rm, errors + 1)
            if same:  # of a node joined with itself, the two crossed pairs are one
                apart = l0 != r0
                crossed = tuple(x[apart] for x in crossed)
            kids.append(crossed)
            nodes = [np.concatenate(x) for x in zip(*kids)]
            alive = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2]) & (nodes[4] <= budget)
            nodes = [x[alive] for x in nodes]
            depth += 1


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Those of the pairs that connect what was not yet connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((i, j))
    return kept


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all the distinct ``fp`` that are within the budget of each other.

    One group holds two blocks, so no group grows with a cluster of near copies; it gives at most
    as many links as it has fingerprints.
    """
    total = fingerprints.count()
    wanted = min(max(total // BLOCK_SIZE, MIN_BLOCKS), MAX_BLOCKS)
    leaves = trie_blocks(fingerprints, max(-(-total // wanted), 1))
    pairs = block_pairs(leaves)
    lows = np.array([prefix << (64 - bits) for bits, prefix in leaves], np.uint64)
    # For each block the pairs it takes part in: a run of (pair, side).
    member = sorted((b, p, side) for p, ab in enumerate(pairs) for side, b in enumerate(ab) if not (side and ab[0] == ab[1]))
    owner = np.array([m[0] for m in member], np.int64)
    pair_of, side_of = (np.array([m[k] for m in member], np.int32) for k in (1, 2))
    first = np.searchsorted(owner, np.arange(len(leaves) + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            block = np.searchsorted(lows, fp.view(np.uint64), side="right") - 1
            times = first[block + 1] - first[block]
            row = np.repeat(np.arange(len(fp)), times)
            slot = first[block][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            columns = {"pair": pair_of[slot], "side": side_of[slot], "fp": fp[row]}
            yield pa.RecordBatch.from_pydict(columns)

    def join(group: pa.Table) -> pa.Table:
        side, fp = group.column("side").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
        left = np.sort(fp[side == 0])
        right = np.sort(fp[side == 1]) if (side == 1).any() else left
        shift = 0 if left is right else len(left)
        values = (left if left is right else np.concatenate([left, right])).view(np.int64)
        kept = forest((i, j + shift) for i, j in near_pairs(left, right))
        ends = np.array(kept, np.int64).reshape(-1, 2)
        return pa.table({"a": values[ends[:, 0]], "b": values[ends[:, 1]]})

    dealt = fingerprints.select("fp").mapInArrow(deal, "pair int, side int, fp bigint")
    return dealt.groupBy("pair").applyInArrow(join, "a bigint, b bigint")


def _linked(docs: DataFrame, id_col: str, text_col: str, mark: Column) -> DataFrame:
    """Per row: doc, mark, fp, n_copies, key (smallest fingerprint of the component), component."""
    rows = docs.select(F.col(id_col).alias("doc"), mark.alias("mark"), F.col(text_col).alias("body"))
    rows = stored(rows.select("doc", "mark", fingerprint_of("body").alias("fp")), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    own = stored(own, "distinct", True)
    found = components(links(own)).select(F.col("id").alias("fp"), F.col("component").alias("key"))
    # Most fingerprints are alone; the others' smallest id is found per component.
    keyed = own.join(found, "fp")
    least = keyed.groupBy("key").agg(F.min("least").alias("component"))
    named = own.join(keyed.join(least, "key").select("fp", "key", "component"), "fp", "left")
    named = named.select(
        "fp",
        "n",
        F.col("n").alias("n_copies"),
        F.coalesce("key", "fp").alias("key"),
        F.when(F.col("key").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"),
    )
    return lookup(rows, stored(named, "components", True), "fp", "n")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id, n_copies.

    Null and empty texts have no words: fingerprint zero, linked like any other. Repeated rows give
    repeated rows. A null id never names a component that has another; a component of null ids only
    has none. n_copies counts the rows with this very fingerprint. Other columns of ``docs`` are not
    read, so their names cannot clash.
    """
    return _linked(docs, id_col, text_col, F.lit(None).cast("bigint")).select(
        F.col("doc").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
        "n_copies",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id (null last), among
    equal ids the one with the smallest hash of its row; of repeated rows one."""
    names = ("_near_id", "_near_mark")
    mark = F.xxhash64(*docs.columns)
    last = F.lit(2**63 - 1)
    rows = _linked(docs, id_col, text_col, mark)
    best = rows.groupBy("key").agg(F.min(F.struct(F.coalesce("doc", last).alias("d"), "mark")).alias("r"))
    best = best.select(F.col("r.d").alias(names[0]), F.col("r.mark").alias(names[1])).distinct()
    tagged = docs.withColumns(dict(zip(names, (F.coalesce(id_col, last), mark))))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    kept = tagged.join(stored(best, "kept", True), list(names), "left_semi").withColumn("_near_rank", rank)
    return kept.where("_near_rank = 1").select(*docs.columns)
