import re
from collections import Counter

from helpers import awkward, doc_table, random_texts

from opslens.llm import ledger


def expected(doc, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (
        doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(repeated),
        sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words),
        sum(a == b for a, b in zip(words, words[1:])),
    )


def test_measures_match_brute_force(spark):
    texts = random_texts(3) + ["a b c d e a b c d e x", "q " * 30, "ÀB !! AB !! <b>|*", "a b c d e\na b c d e"]
    rows = list(enumerate(texts)) + [r[:2] for r in awkward()]
    found = ledger.quality_report(doc_table(spark, rows)).select("doc_id", *ledger.MEASURES).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_policies_read_the_ledger(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(1, clean), (2, "too few"), (3, "same same " * 20), (4, clean.replace(" ", "%%% ")), (5, clean.upper())]
    entries = ledger.ledger(doc_table(spark, rows))
    failed = {r.doc_id: r.failures for r in entries.collect()}
    assert failed == {1: 0, 2: 0b1, 3: 0b10010, 4: 0b100, 5: 0b1000}
    assert {r.doc_id for r in entries.where(ledger.passes(1)).collect()} == {1, 4, 5}
    assert {r.doc_id for r in entries.where(ledger.passes(2)).collect()} == {1}
    effects = {(r.version, r.rule): (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) for r in ledger.ablation(entries).collect()}
    assert effects[1, "few_words"] == (1, 1, 3, 4)
    assert effects[2, "symbols"] == (1, 1, 1, 2)
    assert len(effects) == sum(m.bit_count() for m in ledger.POLICIES.values())


def test_accepted_keeps_columns_and_repeated_rows(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    docs = doc_table(spark, [(1, clean), (1, clean), (2, "few"), (3, None)])
    kept = ledger.accepted(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.collect()[:2]]


def test_empty_table(spark):
    empty = doc_table(spark, [])
    assert ledger.quality_report(empty).collect() == [] and ledger.ablation(ledger.ledger(empty)).collect() == []
