"""Quality rules as a ledger: measure once, store a bit per failed rule, judge by policy afterwards.

A policy is a version and the mask of the rules that count. Changing a policy, or asking what a rule
adds to one, reads the ledger and never the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_list

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words",  # runs of anything but ASCII white space
    "word_chars",  # code points in words
    "n_symbols",
    "n_lines",  # with a word
    "n_dup_lines",  # with a word, equal to an earlier line
    "n_repeat_words",  # in windows of five words found twice or more
    "n_upper",  # words with A-Z and without a-z
    "n_stutter",  # words equal to the one before
)


class Rule(NamedTuple):
    bit: int
    name: str
    fails: Callable[[], Column]


# A rule keeps its bit for ever; a changed rule gets a new one.
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeats", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(3, "shouting", lambda: 2 * F.col("n_upper") > F.col("n_words")),
    Rule(4, "stutter", lambda: 3 * F.col("n_stutter") > F.col("n_words")),
    Rule(5, "dup_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule(6, "word_length", lambda: F.col("word_chars") > 20 * F.col("n_words")),
)
BASE = 0b11
# Version to mask. The last one judges.
POLICIES = {1: BASE, 2: 0b1111111}
CURRENT = max(POLICIES)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` that occur twice or more. Hashes find the windows that may,
    which are then compared as they are."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(count, np.uint64)
    for i in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
    order = np.argsort(windows)
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    often = np.zeros(count, bool)
    often[order[1:][equal]] = often[order[:-1][equal]] = True
    at = np.flatnonzero(often).tolist()
    spelt = [tuple(words[i : i + width]) for i in at]
    times = Counter(spelt)
    starts = np.zeros(len(words), np.int64)
    starts[[i for i, w in zip(at, spelt) if times[w] > 1]] = 1
    covered = np.convolve(starts, np.ones(width, np.int64))[: len(words)]
    return int((covered > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        sum(map(len, words)) - (len(text) - len(text.decode())),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(map(bytes.isupper, words)),
        sum(map(eq, words, words[1:])),
    )


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    rows = [measure(t) for t in byte_list(text)]
    columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(MEASURES))]
    return pa.StructArray.from_arrays(columns, list(MEASURES))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failures``, bit b set if the rule of bit b fails.

    A null text has no words and no lines. Columns of these names are replaced; every row, repeated
    ones too, gets its own entry.
    """
    found = docs.withColumn("_measures", measures(text_col))
    found = found.withColumns({m: F.col(f"_measures.{m}") for m in MEASURES}).drop("_measures")
    bits = [F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(0) for rule in RULES]
    failures = F.lit(0)
    for bit in bits:
        failures = failures.bitwiseOR(bit)
    return found.withColumn("failures", failures.cast("bigint"))


def passes(version: int = CURRENT) -> Column:
    """Whether a ledger entry has none of the failures that a policy counts."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[version])) == 0


def ablation(entries: DataFrame) -> DataFrame:
    """What each rule does in each policy: version, rule, n_failed, n_only (rejected by it alone),
    n_kept and n_kept_without (kept if the rule were gone).

    The ledger shrinks to one row per set of failures before anything else.
    """
    sets = entries.groupBy("failures").agg(F.count("*").alias("n"))
    pairs = [
        F.struct(
            F.lit(version).alias("version"),
            F.lit(rule.name).alias("rule"),
            F.lit(mask).cast("bigint").alias("mask"),
            F.lit(1 << rule.bit).cast("bigint").alias("bit"),
        )
        for version, mask in POLICIES.items()
        for rule in RULES
        if mask >> rule.bit & 1
    ]
    counted = F.col("failures").bitwiseAND(F.col("mask"))
    rest = counted.bitwiseAND(F.bitwise_not("bit"))

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return (
        sets.select("failures", "n", F.inline(F.array(*pairs)))
        .groupBy("version", "rule")
        .agg(
            total(counted.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(counted == F.col("bit")).alias("n_only"),
            total(counted == 0).alias("n_kept"),
            total(rest == 0).alias("n_kept_without"),
        )
    )


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: measurements, failures, base_failed and kept."""
    entries = ledger(docs.select(id_col, text_col), text_col)
    base = F.col("failures").bitwiseAND(F.lit(BASE)) != 0
    return entries.select(
        id_col, *MEASURES, "failures", base.alias("base_failed"), passes().alias("kept")
    )


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass the current policy, with their own columns."""
    kept = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    entries = ledger(docs.select(*(F.col(c).alias(n) for c, n in kept.items())), kept[text_col])
    return entries.where(passes()).select(*(F.col(n).alias(c) for c, n in kept.items()))
