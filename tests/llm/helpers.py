"""Tables for the operators' tests: random texts with shared parts, and the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Names the operators use inside or return.
CLASHING = (
    "fp", "rep", "n", "mark", "doc", "body", "line", "shard", "size", "rate", "copies", "failures",
    "fingerprint", "component_id", "dropped_lines", "n_words", "hash", "key", "chunk", "target",
)
DOCS = "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)

WORDS = "the of and river stone Élan house garden über light water 12 x". split()


def sentences(rng: random.Random, count: int) -> list[str]:
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randrange(3, 14))) for _ in range(count)]


def random_texts(seed: int, count: int = 60) -> list[str]:
    """Texts of lines that many share, some texts nearly alike."""
    rng = random.Random(seed)
    pool = sentences(rng, 40)
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.3:
            words = rng.choice(texts).split(" ")
            if len(words) > 3 and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            own = sentences(rng, 3)
            texts.append("\n".join(rng.choice(pool + own) for _ in range(rng.randrange(1, 9))))
    return texts


def awkward() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and white texts, ties, repeated rows, a very long text."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    line = "a line that several documents have in common, with more than fifty bytes in it"
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "one", "b"), (5, line, "b"),
        (6, f"{line.upper()}\n\n {line} \nend", "b"), (7, line, None), (7, line, None), (8, long, "c"),
        (9, long + " tail", "c"), (None, line, "a"), (None, None, None), (10, f"\n{line}\n{line}\r", "é"),
        (11, "Ünïcode ÀÉ ßtraße x " * 9, "é"), (12, "\U0001f600 " * 20, "𝒳"), (13, "x" * 3000, "z"),
        (14, "x" * 3000 + "y", "z"), (-5, line, ""), (15, "jane@example.org and 4111111111111111", ""),
    ]


def doc_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    full = [(*r, *(["a"] if len(r) == 2 else []), *CLASHING) for r in rows]
    return spark.createDataFrame(full, DOCS)


def text_of(rows: list[tuple]) -> list[tuple]:
    return [(r[0], r[1] or "") for r in rows]
