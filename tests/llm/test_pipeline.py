"""The pipeline against plain versions of its stages, and what every registered query promises."""

import re

import pytest
from helpers import awkward, random_texts
from test_containment import shingles
from test_ledger import expected as plain_measures
from test_linededup import key_of
from test_mixing import check
from test_similar import near
from test_similar import shingles as plain_shingles

import __spark_entry__
import corpus_pipeline
from opslens.llm import queries

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    texts = random_texts(11, 120)
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, t, None, s, None) for i, (_, t, s) in enumerate(awkward())]
    words = texts[5].split()
    # A near copy: too far for equal fingerprints, near enough by five-word shingles; and one that is not.
    long = [f"word{i}" for i in range(120)]
    for doc, step in ((700, 0), (701, 100), (702, 7)):
        rows.append((doc, " ".join(w + "x" * (step and i % step == 3) for i, w in enumerate(long)), "en", "src2", 0))
    rows.append((900, " ".join(words[:3] + ITEM.upper().split() + words[3:]) + " and some more words here", "en", "src1", 0))
    return rows


ITEM = "a test item of nine words that must not leak out"


def plain_pipeline(rows):
    kept = []
    for doc, text, lang, source, n in rows:
        _, words, chars, symbols, lines, dup, repeat, upper, stutter = plain_measures(doc, text)
        failed = (
            words < 10, 100 * repeat > 20 * words, 10 * symbols > words, 2 * upper > words, 3 * stutter > words,
            2 * dup > lines, chars > 20 * words,
        )
        if not any(failed):
            kept.append((doc, text, lang, source, n))
    holders = {}
    for doc, text, *_ in kept:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders.setdefault(key_of(line), set()).add(doc)
    cut = []
    for doc, text, lang, source, _ in kept:
        lines = [x for x in text.split("\n") if min(holders.get(key_of(x), {doc})) == doc]
        cut.append((doc, "\n".join(lines), lang, source, len("\n".join(lines))))
    sets, group = [plain_shingles(t) for _, t, *_ in cut], list(range(len(cut)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and near(a, b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r[0] for r, h in zip(cut, group) if h == g) for g in group}
    single = [r for r, g in zip(cut, group) if r[0] == least[g]]
    item = shingles(ITEM)
    return [r for r in single if 5 * len(item & shingles(r[1])) < 4 * len(item)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        path = f"{folder}/stage{i}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    wanted = plain_pipeline(corpus())
    assert not {900, 701} & {r[0] for r in wanted} and {700, 702} <= {r[0] for r in wanted}
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(wanted, key=repr)
    rows = [(r[0], r[1], r[3]) for r in wanted]
    check(rows, corpus_pipeline.run(spark, folder).collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) >= {n for n, (_, sql) in queries.QUERIES.items() if sql}
