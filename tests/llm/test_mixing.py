import math
import random
import re
from collections import defaultdict

import pytest
from helpers import awkward, doc_table, random_texts

from opslens.llm import mixing


def targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped = set()
    while True:
        free = [s for s in order if s not in stopped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        level = rest / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    return {s: (sizes[s], 3.0 * sizes[s] if s in stopped else weight[s] * level) for s in order}


def check(rows, found):
    wanted = targets(rows)
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        size, target = wanted[r.source]
        assert (r.source_size, r.taken) == (size, r.copies * r.size)
        assert r.target == pytest.approx(target)
        assert 0 <= r.taken <= 3 * r.size
        if r.size:
            assert int(r.rate) <= r.copies <= -(-r.rate // 1)
        taken[r.source] += r.taken
    return wanted, taken


def test_targets_are_met(spark):
    rng = random.Random(6)
    names = ["zeta", "Alpha", "beta", "é", "𝒳", None, ""]
    rows = [(i, t, rng.choice(names[: 3 + i % 5])) for i, t in enumerate(random_texts(6, 300))]
    found = mixing.mixed(doc_table(spark, rows)).collect()
    wanted, taken = check(rows, found)
    for source, (size, target) in wanted.items():
        assert taken[source] == pytest.approx(target, rel=0.03, abs=30), (source, size)
    again = mixing.mixed(doc_table(spark, rows[::-1])).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("longest", [100_000, 1_000_000])
def test_remainder_of_a_very_long_document(spark, longest):
    """The long document's fraction is taken by a thousand other sizes."""
    rows = [(n, "w " * n, "a") for n in range(100, 1100)] + [(1, "v " * longest, "a"), (2, "x " * 1_007_037, "b")]
    wanted, taken = check(rows, mixing.mixed(doc_table(spark, rows)).collect())
    assert taken["a"] == pytest.approx(wanted["a"][1], rel=0.001)


def test_rates_lie_on_one_curve(spark):
    """Rates are exp(tilt * size) per source, cut at three: the entropy's optimum."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 200), f"s{i % 3}") for i in range(400)]
    for source in ("s0", "s1", "s2"):
        points = [(r.size, r.rate) for r in mixing.mixed(doc_table(spark, rows)).collect() if r.source == source and r.rate < 2.9]
        tilts = [math.log(rate) / size for size, rate in points]
        assert max(tilts) - min(tilts) < 1e-9
        words = sum(size * rate for size, rate in points)
        if all(r < 2.9 for _, r in points) and len(points) == sum(r[2] == source for r in rows):
            assert words == pytest.approx(targets(rows)[source][1], rel=1e-6)


def test_small_sources_stop_at_three_times(spark):
    rows = [(1, "a b c", "s1"), (2, "d e", "s2"), (3, "w " * 500, "s3"), (4, "v " * 300, "s4")]
    found = mixing.mixed(doc_table(spark, rows)).collect()
    check(rows, found)
    assert {r.doc_id: r.copies for r in found if r.doc_id < 3} == {1: 3, 2: 3}


def test_one_size_of_a_hot_source(spark):
    """Thousands of equally long documents get whole copies that add up."""
    rows = [(i, "four words are here", "hot") for i in range(3000)] + [(-1, "x " * 9000, "big")]
    wanted, taken = check(rows, found := mixing.mixed(doc_table(spark, rows)).collect())
    # "big" weighs five, "hot" two; a single document of 9,000 words can't be split.
    assert taken["hot"] == pytest.approx(wanted["hot"][1], abs=4)
    assert len({r.copies for r in found if r.source == "hot"}) <= 2


def test_awkward_rows(spark):
    check(awkward(), mixing.mixed(doc_table(spark, awkward())).collect())


def test_nothing_to_take(spark):
    assert mixing.mixed(doc_table(spark, [])).collect() == []
    found = mixing.mixed(doc_table(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
