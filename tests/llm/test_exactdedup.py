"""Exact dedup against a plain version: copies by white space, weak hashes, odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from opslens.llm import exactdedup

from helpers import awkward, doc_table, random_texts


def plain(rows):
    """(doc_id, keep_id, group_size, sha) per row."""
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        first = min(members, key=lambda m: (-len(m[1]), m[0] is not None, m[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(doc, first[0], len(members), sha) for doc, _ in members]
    return sorted(out, key=str)


def spaced(rows):
    """Copies of the rows that differ in white space only."""
    return [(1000 + n, " " * (n % 3) + (t or "").replace(" ", "\n " if n % 2 else ""), "w") for n, (_, t, *_) in enumerate(rows)]


ROWS = awkward() + [(100 + n, t, "r") for n, t in enumerate(random_texts(5))]
ROWS += spaced(ROWS)


# Every text under one hash, and some texts under each.
@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.lit("0"), lambda c: F.length(c).cast("string")])
def test_like_plain(spark, content_hash):
    found = exactdedup.exact_copies(doc_table(spark, ROWS), content_hash=content_hash).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == plain(ROWS)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay(spark):
    docs = doc_table(spark, ROWS)
    kept = exactdedup.without_copies(docs)
    assert kept.columns == docs.columns
    expected = {(keep, sha) for _, keep, _, sha in plain(ROWS)}
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([keep for keep, _ in expected], key=str)


def test_very_common_text(spark):
    rows = [(n, "the same text" if n % 3 else f"text {n}", "a") for n in range(6000)]
    found = exactdedup.exact_copies(doc_table(spark, rows).repartition(16)).where("kept").collect()
    assert {(r.doc_id, r.group_size) for r in found if r.group_size > 1} == {(1, 4000)}
    assert len(found) == 2001


def test_empty_table(spark):
    assert exactdedup.exact_copies(doc_table(spark, [])).count() == 0
    assert exactdedup.without_copies(doc_table(spark, [])).count() == 0


def test_bytes_meet_once_per_split(spark):
    """Texts are grouped with partial counts, and only hashes are joined."""
    docs = doc_table(spark, [(n, "x y", "a") for n in range(50)])
    texts = docs.select(F.md5("text").alias("hash"), F.col("text").alias("norm"))
    plan = exactdedup.collisions(texts, texts.groupBy("hash").agg(F.count("*").alias("n")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "SortAggregate" not in text
