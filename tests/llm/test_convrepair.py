"""Conversation repair against exhaustive search, whole and in pieces."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from opslens.llm import convrepair
from opslens.llm.convrepair import END, FAR, START, applied, closing, edits, step, transfer

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, mark string, kind string, letters string"


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, must, cut): every edit tried in every state."""
    succ = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        want = succ[last]
        if inserts < 3:
            cost, audit, lines = best(i, want, inserts + 1)
            options.append((cost + 2, "I" + audit, (f"{names[want]}:", *lines)))
        if i < len(rows):
            role, text, must, cut = rows[i]
            cost, audit, lines = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, lines))
            if not must:
                if role[:1] == want or role[:1] == "s" and last == "":
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    options.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(i + 1, want, 0)
                options.append((cost + 2 + cut, "R" + audit, (f"{names[want]}:{text}", *lines)))
        return min(options, key=lambda o: o[:2], default=(10**9, "~", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that long conversations do not recurse deeply
        for last in succ:
            best(i, last, 0)
    return best(0, "", 0)


def plain(rows):
    """The report for damaged rows (turn, role, text) of one conversation, in order."""
    white = " \t\n\x0b\x0c\r"
    seen, judged, blank, again, cut = set(), [], 0, 0, 0
    for _, role, text in rows:
        is_blank, is_again = not text.strip(white), (role, text) in seen
        seen.add((role, text))
        is_cut = not (is_blank or is_again) and text.rstrip(white)[-1:] not in (".", "!", "?")
        blank, again, cut = blank + is_blank, again + (is_again and not is_blank), cut + is_cut
        judged.append((role, text, is_blank or is_again, int(is_cut)))
    cost, audit, lines = cheapest(tuple(judged))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, blank, again, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        harm = zlib.crc32(name.encode()) % 20
        if harm:
            text = "" if harm == 1 else text.translate({ord(c): None for c in ".!?"}) if harm == 2 else text
            out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def expected(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest())
    kept = harmed(rows)
    return {conv: plain([r[1:] for r in sorted((r for r in kept if r[0] == conv), key=key)]) for conv in {r[0] for r in rows}}


def random_rows(seed, convs=60, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "open end", "", " \n", "Yes.", "a. b", "Über. \t", "x" * 3000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown", None]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]), rng.choice(roles), rng.choice([*texts, None])))
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Oh."), (900, None, None, None), (901, 3, "user", "Hi.")] + rows[:9]


def report(spark, rows, parts=None):
    table = spark.createDataFrame([(*r, "c", "m", "k", "l") for r in rows], SCHEMA)
    table = table.repartition(parts) if parts else table
    found = convrepair.repair_report(convrepair.damaged(table), table.select(F.col("conv_id").alias("conv")))
    rows = found.collect()
    assert len(rows) == len({r.conv for r in rows})
    return {r.conv: tuple(r)[1:] for r in rows}


def test_like_exhaustive_search(spark):
    rows = random_rows(1)
    found, theirs = report(spark, rows, 3), expected(rows)
    assert {c: (found[c], theirs[c]) for c in theirs if found.get(c) != theirs[c]} == {}
    assert set(found) == set(theirs)


def test_one_conversation_in_many_groups(spark):
    """Most rows belong to one conversation, which lies in all groups."""
    rng = random.Random(2)
    long = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same.", ""])) for t in range(500)]
    rows = long + [(c, t, "user", f"{t}.") for c in (3, 5, 8, 9) for t in range(4)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert report(spark, rows) == expected(rows)
        table = spark.createDataFrame([(*r, "c", "m", "k", "l") for r in rows], SCHEMA)
        harmful = convrepair.damaged(table).cache()
        plan = convrepair.edit_plan(harmful)
        lines = convrepair.repaired(harmful, plan).where("conv = 7").orderBy("turn", "said", "mark", "step").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    spoken = "\n".join(f"{r.role}:{r.text}" for r in lines)
    assert hashlib.sha256(spoken.encode()).hexdigest() == expected(rows)[7][-1]
    initials = "".join(r.role[0] for r in lines).removeprefix("s")
    assert len(initials) > 100 and initials == "ua" * (len(initials) // 2)


@pytest.mark.parametrize("seed", range(5))
def test_blocks_give_the_least_plan(seed):
    rng = random.Random(seed)
    for n in [1, 2, 3, 5, 8, 17, 60]:
        kinds = [rng.choice([None, ("s", False), ("u", False), ("a", False), ("", False), ("u", True), ("a", True)]) for _ in range(n)]
        rows = tuple(("x" if k is None else k[0] or "t", "", k is None, int(bool(k and k[1]))) for k in kinds)
        cost, audit, _ = cheapest(rows)
        found = list(edits(kinds))
        letters = "".join(f[0] for f in found) + closing(found[-1][2])[0]
        assert letters == audit
        vector = END
        for kind in reversed(kinds):
            vector = step(kind, vector)
        assert vector[START] == cost
        # The same in two pieces.
        cut = rng.randrange(n + 1)
        front, back = kinds[:cut], kinds[cut:]
        middle = applied(transfer(back), END)
        assert applied(transfer(front), middle) == vector
        first = list(edits(front, middle))
        rest = list(edits(back, END, first[-1][2] if first else START))
        assert [*first, *rest] == found
    assert max(c for c in vector) < FAR


def test_dropped_conversations_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert report(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert report(spark, []) == {}


def test_very_common_row(spark):
    """One row many times: the first stays, the others are duplicates."""
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 > 4)
    found = report(spark, [(conv, 1, "user", "Hi.")] * 3000, 8)[conv]
    assert found[:6] == (0, 0, 2999, 0, 2999, 2999 * 3 + 2)
    assert found[6] == "K" + "D" * 2999 + "I"
