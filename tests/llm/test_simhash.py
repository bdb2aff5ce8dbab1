import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward, doc_table, random_texts

from opslens.llm import simhash
from opslens.llm.common import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    count = max(len(words) - 2, 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(count)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def expected(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    members = defaultdict(list)
    group = plain_components(prints)
    for (doc, *_), g in zip(rows, group):
        members[g].append(doc)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in members.items()}
    return sorted(((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group)), key=repr)


@pytest.mark.parametrize("size", [(1, 1), (70, 40), (900, 400)])
def test_trie_join_finds_all_pairs_once(size):
    rng = np.random.default_rng(size[0])
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2)

    def near(count):
        flips = np.uint64(1) << rng.integers(0, 64, count).astype(np.uint64)
        return np.unique(seeds[rng.integers(0, 12, count)] ^ flips)

    left, right = near(size[0]), near(size[1])
    for a, b in ((left, right), (left, left)):
        found = [p for i, j in simhash.near_pairs(a, b) for p in zip(i.tolist(), j.tolist())]
        wanted = np.bitwise_count(a[:, None] ^ b[None, :]) <= 2
        if a is b:
            wanted &= np.triu(np.ones_like(wanted), 1)
        assert sorted(found) == sorted(zip(*(x.tolist() for x in np.nonzero(wanted))))


def test_block_pairs_cover_all_near_prefixes():
    leaves = [(2, 0), (3, 2), (3, 3), (1, 1)]
    assert sorted(map(sorted, simhash.block_pairs(leaves))) == sorted(
        sorted((a, b)) for a in range(4) for b in range(a, 4)
    )
    deep = [(4, p) for p in range(16)]
    wanted = sorted((a, b) for a in range(16) for b in range(a, 16) if (a ^ b).bit_count() <= 2)
    assert sorted(tuple(sorted(p)) for p in simhash.block_pairs(deep)) == wanted


def test_matches_brute_force(spark):
    rows = [(i * 3 % 61, t) for i, t in enumerate(random_texts(1))]
    found = simhash.linked(doc_table(spark, rows)).drop("n_copies").collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_awkward_rows(spark):
    found = simhash.linked(doc_table(spark, awkward())).drop("n_copies").collect()
    assert sorted(map(tuple, found), key=repr) == expected(awkward())


def test_one_of_each(spark):
    docs = doc_table(spark, awkward())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    group = plain_components([plain_fingerprint(t) for _, t, _ in awkward()])
    best = {}
    for (doc, text, _), g in zip(awkward(), group):
        best[g] = min(best.get(g, 1 << 70), 1 << 69 if doc is None else doc)
    assert sorted(1 << 69 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(best.values())


def test_empty_table(spark):
    empty = doc_table(spark, [])
    assert simhash.linked(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []


def test_long_chains_end_in_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (5000, 5000)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in found} == {**{i: 0 for i in range(301)}, **dict.fromkeys(range(1000, 1003), 1000)}
