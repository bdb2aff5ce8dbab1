import hashlib
from collections import defaultdict

import numpy as np
from helpers import awkward, doc_table, random_texts

from opslens.llm import linededup

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    key = line.strip(WHITE)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def order(doc):
    return -(2**63) if doc is None else doc


def expected(rows):
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders[key_of(line)].add(order(doc))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < 2 or min(holders[key_of(x)]) == order(doc)]
        text = "\n".join(kept)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64))
    table = linededup.PerfectHash.of(keys)
    assert sorted(table.numbers(keys).tolist()) == list(range(len(keys)))
    assert len(linededup.PerfectHash.of(keys[:0]).numbers(keys[:3])) == 3


def test_matches_brute_force(spark):
    rows = [(i * 7 % 61, t) for i, t in enumerate(random_texts(2))]
    found = linededup.line_report(doc_table(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_many_slices(spark, monkeypatch):
    """The probes of a common line are dealt over several groups."""
    monkeypatch.setattr(linededup, "GROUP_PROBES", 5)
    rows = [(i, f"the very same line\nown line number {i}\n{'x' * (i % 3 + 9)}") for i in range(60)]
    found = linededup.line_report(doc_table(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_awkward_rows(spark):
    found = linededup.line_report(doc_table(spark, awkward())).collect()
    assert sorted(map(tuple, found), key=repr) == expected(awkward())


def test_texts_lose_the_lines(spark):
    docs = doc_table(spark, awkward())
    cut = linededup.without_repeats(docs)
    assert cut.columns == docs.columns
    wanted = [(d, h) for d, _, _, h in expected(awkward())]
    found = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_empty_table(spark):
    assert linededup.line_report(doc_table(spark, [])).collect() == []
