import random
import re

import numpy as np
import pytest
from helpers import awkward, doc_table, random_texts

from pyspark.sql import functions as F

from opslens.llm import containment


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(docs, items):
    out = {}
    for doc, text, *_ in docs:
        for item, test in items:
            a, b = shingles(text), shingles(test)
            if b and 5 * len(a & b) >= 4 * len(b):
                out[doc, item] = max(out.get((doc, item), (0, 0, 0)), (len(a & b) / len(b), len(a & b), len(b)))
    return sorted(((d, i, n, size, share) for (d, i), (share, n, size) in out.items()), key=repr)


def items_and_docs(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 5, 6, 9, 14, 33, 60])))) for i in range(25)]
    docs = []
    for i, text in enumerate(random_texts(seed, 40)):
        words = text.split(" ")
        for _, test in rng.sample(items, 3):
            own = test.split()
            # Whole, in upper case, or with changed words: near the threshold on both sides.
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in own] if rng.random() < 0.3 else own
        docs.append((i, " ".join(words)))
    return items + [(100, None), (101, ""), (102, items[3][1]), (None, items[4][1]), (103, "x " * 40)], docs


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    items, docs = items_and_docs(seed)
    docs += [r[:2] for r in awkward()] + [docs[0], (docs[0][0], docs[1][1]), (200, "x " * 9)]
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    found = containment.contained(doc_table(spark, docs), tests).collect()
    assert sorted(map(tuple, found), key=repr) == expected(docs, items)
    assert found


def test_a_full_filter_is_slow_but_right(spark, monkeypatch):
    monkeypatch.setattr(containment, "FILTER_BITS", 64)
    items, docs = items_and_docs(3)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    found = containment.contained(doc_table(spark, docs), tests).collect()
    assert sorted(map(tuple, found), key=repr) == expected(docs, items)


def test_sketch_sizes_leave_no_item_out():
    """Fewer than k of n shingles are absent from a document with the share, for every size."""
    share, whole = containment.SHARE
    for n in range(1, 300):
        most = 1 << int(np.ceil(np.log2(n)))
        k = most - -(-most * share // whole) + 1
        assert n - -(-n * share // whole) < k


def test_leaks_go(spark):
    items, docs = items_and_docs(1)
    docs += [r[:2] for r in awkward()]
    table = doc_table(spark, docs)
    kept = containment.without_leaks(table, spark.createDataFrame(items, "item_id bigint, text string"))
    leaks = {d for d, *_ in expected(docs, items)}
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, *_ in docs if d not in leaks), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert containment.contained(doc_table(spark, awkward()), none).collect() == []
    assert containment.contained(doc_table(spark, []), some).collect() == []


def test_only_what_the_sketches_find_is_verified(spark, monkeypatch):
    """An item whose sketch holds nothing is not found, though documents hold all of it."""
    items = [(1, " ".join(f"a{i}" for i in range(12))), (2, " ".join(f"b{i}" for i in range(12)))]
    docs = doc_table(spark, [(1, items[0][1]), (2, items[1][1]), (3, items[0][1] + " and " + items[1][1])])
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    pairs = lambda: sorted((r.doc_id, r.item_id, r.n_common) for r in containment.contained(docs, tests).collect())
    assert pairs() == [(1, 1, 8), (2, 2, 8), (3, 1, 8), (3, 2, 8)]
    real = containment.sketches
    monkeypatch.setattr(containment, "sketches", lambda rows: real(rows).withColumn("in_sketch", F.col("in_sketch") & (F.col("item") != 2)))
    assert pairs() == [(1, 1, 8), (3, 1, 8)]
