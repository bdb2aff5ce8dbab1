"""Masking against a parser: random texts, broken texts, deep nesting."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from opslens.functions.masking import SENSITIVE_FRAGMENTS, fold_json, mask_json

NAMES = ["a", "token", "Api_Key", "to\\u006Ben", 'x\\"auth', "é", "[", "ACCESS\\u005Fkey"]


class Pairs(list):
    """An object as its pairs, so that repeated names stay."""


def sensitive(name):
    return any(f in name.lower() for f in SENSITIVE_FRAGMENTS)


def masked(value):
    if isinstance(value, Pairs):
        return Pairs((k, "***" if sensitive(k) else masked(v)) for k, v in value)
    return [masked(v) for v in value] if isinstance(value, list) else value


def plain(value):
    """Objects and lists told apart."""
    if isinstance(value, Pairs):
        return ("object", [(k, plain(v)) for k, v in value])
    return ("list", [plain(v) for v in value]) if isinstance(value, list) else repr(value)


def read(text):
    return json.loads(text, object_pairs_hook=Pairs)


def random_json(rng, depth):
    blank = lambda: rng.choice(["", "", " ", "\n\t"])
    kind = rng.random()
    if depth <= 0 or kind < 0.3:
        return rng.choice(["1", "-0.5e3", '"x"', '"\\"token\\":1"', "null", "true", '"é\\n"', '"secret"', "1e999", '"𝒳{"'])
    if kind < 0.65:
        pairs = (f'"{rng.choice(NAMES)}"{blank()}:{blank()}{random_json(rng, depth - 1)}{blank()}' for _ in range(rng.randrange(4)))
        return "{" + blank() + ("," + blank()).join(pairs) + "}"
    return "[" + blank() + ("," + blank()).join(random_json(rng, depth - 1) + blank() for _ in range(rng.randrange(4))) + "]"


def texts(seed):
    rng = random.Random(seed)
    whole = [random_json(rng, rng.randrange(1, 8)) for _ in range(1500)]
    broken = []
    for text in whole[:700]:
        at = rng.randrange(len(text))
        broken.append(text[:at] + rng.choice(["", ",", "}", "]", '"', "{", ":", "\x01"]) + text[at + 1 :])
    return whole + broken


def test_like_a_parser(spark):
    rows = spark.createDataFrame([(t,) for t in texts(1)], "t string")
    for r in rows.select("t", mask_json(F.col("t")).alias("m"), fold_json(F.col("t")).alias("f")).collect():
        decoded = re.sub(r"\\u00([0-7][0-9a-fA-F])", lambda m: chr(int(m[1], 16)), r.t)
        if not sensitive(decoded):
            assert r.m == r.t
            continue
        try:
            wanted = plain(masked(read(r.t)))
        except ValueError:
            assert r.m == '"***"' and r.f == '"***"', r.t
            continue
        assert plain(read(r.m)) == wanted, r.t
        assert r.f == r.m, r.t


def test_other_bytes_stay(spark):
    """What is left of a text when its masked values are cut out is the same before and after."""
    rows = spark.createDataFrame([(t,) for t in texts(2)], "t string")
    for r in rows.select("t", mask_json(F.col("t")).alias("m")).where("m <> t and m <> '\"***\"'").collect():
        kept = "(?s:.+?)".join(map(re.escape, r.m.split('"***"')))
        assert re.fullmatch(kept, r.t)


@pytest.mark.parametrize(
    ("before", "after", "wanted"),
    [
        ('{"token":' + "[" * 200_000, "]" * 200_000 + ',"k":1}', '{"token":"***","k":1}'),
        ("[" * 200_000 + '{"auth":', "}" + "]" * 200_000, "[" * 200_000 + '{"auth":"***"}' + "]" * 200_000),
        ('{"a":[' * 20_000 + '{"auth":', "}" + "]}" * 20_000, '{"a":[' * 20_000 + '{"auth":"***"}' + "]}" * 20_000),
        ('{"a":[' * 20_000 + '{"auth":', "}" + "]}" * 19_999 + "}]", '"***"'),
        ('{"token":"' + "x" * 3_000_000, '"}', '{"token":"***"}'),
        ('{"k":"\\ud800","auth":"', '\\ud800"}', '{"k":"\\ud800","auth":"***"}'),
    ],
)
def test_deep_and_long(spark, before, after, wanted):
    text = spark.createDataFrame([(before + "1" + after,)], "t string")
    assert text.select(mask_json(F.col("t"))).first()[0] == wanted


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(mask_json(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
