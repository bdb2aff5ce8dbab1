"""Conversation structure repair: the cheapest edits by a square-root checkpointed dynamic program.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Walking through it, the state
says what was last kept: nothing, a system turn, a user turn, an assistant turn. A vector holds the
cost from here to the end for each state. Backwards, vectors are stored at checkpoints only, one per
about the square root of the rows; forwards, each block's vectors are worked out again from the
checkpoint behind it, and of the tight edits (those that keep to the cost) the first letter is taken.

Rows are dealt by ranges of (conversation, turn), so a very long conversation lies in many groups. Its
pieces are 4 x 4 matrices of costs to each other; the driver sees these for the at most two
conversations per group that reach over its ends, and gives each piece the vector behind it and the
state before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import stored

WHITE = r"[\x20\x09-\x0D]"
ENDS = "[.!?]"
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
# The state that the next inserted or reroled turn leads to, and a kept turn by its initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]
# Of a row that may stay: its role's initial if s, u or a, and whether it is truncated. None: it must go.
Kind = tuple[str, bool] | None


def relaxed(costs: list[int]) -> Vector:
    """Costs with insertions."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]], FAR) for s, c in enumerate(costs)]
    return tuple(costs)


END = relaxed([0, FAR, FAR, 0])


def _less(vector: Vector) -> tuple[int, Vector]:
    least = min(vector)
    return least, tuple(c if c >= FAR else c - least for c in vector)


@lru_cache(4096)
def _step(kind: Kind, after: Vector) -> Vector:
    if kind is None:
        return tuple(min(c + DELETE, FAR) for c in after)
    initial, truncated = kind
    costs = []
    for state, cost in enumerate(after):
        kept = KEEP[state].get(initial)
        keep = FAR if kept is None else truncated * CUT + after[kept]
        costs.append(min(DELETE + cost, keep, REROLE + truncated * CUT + after[NEXT[state]], FAR))
    return relaxed(costs)


def step(kind: Kind, after: Vector) -> Vector:
    """The vector before a row, from the one behind it. Vectors less their minimum are few."""
    least, own = _less(after)
    return tuple(min(c + least, FAR) for c in _step(kind, own))


@lru_cache(16384)
def _walk(kind: Kind, after: Vector, state: int) -> tuple[str, str, int]:
    before, letters, made = _step(kind, after), "", ""
    while DELETE + after[state] != before[state]:
        into = NEXT[state]
        if INSERT + before[into] == before[state]:
            letters, made, state = letters + "I", made + ROLE[into][0], into
            continue
        initial, truncated = kind
        kept = KEEP[state].get(initial)
        if kept is not None and truncated * CUT + after[kept] == before[state]:
            return letters + "K", made, kept
        return letters + "R", made + ROLE[into][0], into
    return letters + "D", made, state


def walk(kind: Kind, after: Vector, state: int) -> tuple[str, str, int]:
    """The least tight edits of a row: their letters, the initials they insert or set, the new state."""
    return _walk(kind, _less(after)[1], state)


def closing(state: int) -> tuple[str, str]:
    """Letters and initials of the insertions behind the last row."""
    letters, made = "", ""
    while END[state]:
        state = NEXT[state]
        letters, made = letters + "I", made + ROLE[state][0]
    return letters, made


def edits(kinds: list[Kind], behind: Vector = END, state: int = START) -> Iterator[tuple[str, str, int]]:
    """What ``walk`` says of each row, first to last, with about sqrt(rows) vectors in memory."""
    n = len(kinds)
    block = isqrt(n) + 1
    vector, checkpoints = behind, {}
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0 or i == n - 1:
            checkpoints[i + 1] = vector
        vector = step(kinds[i], vector)
    for first in range(0, n, block):
        last = min(first + block, n)
        inside = [checkpoints[last]]
        for i in range(last - 1, first, -1):
            inside.append(step(kinds[i], inside[-1]))
        for i in range(first, last):
            letters, made, state = walk(kinds[i], inside.pop(), state)
            yield letters, made, state


def transfer(kinds: list[Kind]) -> list[Vector]:
    """Columns of the matrix that makes the vector before the rows out of the one behind them."""
    columns = []
    for state in range(4):
        vector = relaxed([0 if s == state else FAR for s in range(4)])
        for kind in reversed(kinds):
            vector = step(kind, vector)
        columns.append(vector)
    return columns


def applied(columns: list[Vector], behind: Vector) -> Vector:
    return tuple(min(min(c[s] + b for c, b in zip(columns, behind)), FAR) for s in range(4))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with one row in four harmed: by crc32 of ``conv:turn`` modulo 20 a row
    is dropped (0), emptied (1), loses its [.!?] (2), comes twice (3) or gets the role user (4). A null
    role, text or part of the name is one space; a null conversation or turn stays null."""
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in (conv, turn)))
    harm = F.pmod(F.crc32(name), F.lit(20))
    body = F.coalesce(text, space)
    copies = F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(harm != 0).select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(harm == 4, "user").otherwise(F.coalesce(role, space)).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(body, ENDS, "")).otherwise(body).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


KEY = ["conv", "turn", "role", "mark"]


def marked(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), "text")


def turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) without texts, one per distinct row: copies, whether blank or
    truncated, and whether an earlier turn says the same (later)."""
    bare = F.regexp_replace("text", f"{WHITE}+$", "")
    seen = marked(rows).select(
        *KEY, (bare == "").alias("blank"), (~bare.rlike(f"{ENDS}$")).alias("truncated")
    )
    slim = seen.groupBy(*KEY, "blank", "truncated").agg(F.count("*").alias("copies"))
    slim = stored(slim, "turns", True)
    said = slim.groupBy("conv", "role", "mark").agg(
        F.count("*").alias("times"), F.min("turn").alias("first"), F.max(F.isnull("turn")).alias("early")
    )
    said = stored(said.where("times > 1").drop("times"), "said", True)
    same = [slim[c].eqNullSafe(said[c]) for c in ("conv", "role", "mark")]
    later = F.when(said["early"], slim["turn"].isNotNull()).otherwise(slim["turn"] > said["first"])
    return slim.join(said, same, "left").select(slim["*"], F.coalesce(later, F.lit(False)).alias("later"))


class Piece(NamedTuple):
    """Rows ``start`` to ``stop`` of a group hold one conversation, or a part of it."""

    conv: object
    start: int
    stop: int
    kinds: list[Kind]


def sorted_group(group: pa.Table) -> pa.Table:
    order = pc.sort_indices(group, sort_keys=[(c, "ascending") for c in KEY], null_placement="at_start")
    return group.take(order)


def pieces(group: pa.Table) -> Iterator[Piece]:
    """The conversations of a sorted group."""
    convs, roles = group.column("conv").to_pylist(), group.column("role").to_pylist()
    must, cut = (pc.or_(group.column("blank"), group.column("later")).to_pylist(), group.column("truncated").to_pylist())
    kinds = [None if m else (r[:1] if r[:1] in ("s", "u", "a") else "", c) for r, m, c in zip(roles, must, cut)]
    start = 0
    for at in range(1, len(convs) + 1):
        if at == len(convs) or convs[at] != convs[start]:
            yield Piece(convs[start], start, at, kinds[start:at])
            start = at


# What a piece of a conversation that reaches over the ends of its group knows of the others: the
# vector behind it, the state before it, and whether it is the last one.
Place = tuple[Vector, int, bool]
ALONE: Place = (END, START, True)


def _behind(placed: DataFrame) -> list[tuple[int, object, Vector, bool]]:
    """Pieces of conversations that lie in several groups, in order: group, conversation, vector
    behind the piece, whether it is the last."""

    def ends(group: pa.Table) -> pa.Table:
        group = sorted_group(group)
        found = list(pieces(group))
        found = found if len(found) == 1 else [found[0], found[-1]]
        flat = [[c for column in transfer(p.kinds) for c in column] for p in found]
        return pa.table(
            {
                "p": pa.array([group.column("p")[0].as_py()] * len(found), pa.int32()),
                "conv": pa.array([p.conv for p in found], group.schema.field("conv").type),
                "opens": [p.start == 0 for p in found],
                "closes": [p.stop == group.num_rows for p in found],
                "costs": pa.array(flat, pa.list_(pa.int64())),
            }
        )

    kind = placed.schema["conv"].dataType.simpleString()
    seen = placed.groupBy("p").applyInArrow(ends, f"p int, conv {kind}, opens boolean, closes boolean, costs array<bigint>")
    rows = sorted(seen.collect(), key=lambda r: (r.p, r.closes, not r.opens))
    chains, open_chain = [], []
    for r in rows:
        if open_chain and not (r.opens and r.conv == open_chain[-1].conv and r.p != open_chain[-1].p):
            chains, open_chain = [*chains, open_chain], []
        open_chain = [*open_chain, r] if r.closes or open_chain else []
        if open_chain and not r.closes:
            chains, open_chain = [*chains, open_chain], []
    found = []
    for chain in [*chains, open_chain]:
        vector, own = END, []
        for r in reversed(chain if len(chain) > 1 else []):
            own.append((r.p, r.conv, vector, not own))
            vector = applied([tuple(r.costs[4 * s : 4 * s + 4]) for s in range(4)], vector)
        found += reversed(own)
    return found


def _places(placed: DataFrame) -> dict[tuple[int, object], Place]:
    """The place of every piece that is not a whole conversation; at most two for each group."""
    behind = _behind(placed)
    if not behind:
        return {}
    vectors = {(p, conv): vector for p, conv, vector, _ in behind}

    def leads(group: pa.Table) -> pa.Table:
        group, rows = sorted_group(group), []
        p = group.column("p")[0].as_py()
        for piece in pieces(group):
            if (p, piece.conv) in vectors:
                for state in range(4):
                    into = state
                    for _, _, into in edits(piece.kinds, vectors[p, piece.conv], state):
                        pass
                    rows.append((p, piece.conv, state, into))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), group.schema.field("conv").type, pa.int32(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["p", "conv", "state", "into"])

    kind = placed.schema["conv"].dataType.simpleString()
    groups = placed.sparkSession.createDataFrame([(p,) for p in sorted({p for p, *_ in behind})], "p int")
    inside = placed.join(F.broadcast(groups), "p")
    seen = inside.groupBy("p").applyInArrow(leads, f"p int, conv {kind}, state int, into int")
    into = {(r.p, r.conv, r.state): r.into for r in seen.collect()}
    places, state = {}, START
    for p, conv, vector, last in behind:
        places[p, conv] = (vector, state, last)
        state = START if last else into[p, conv, state]
    return places


def edit_plan(rows: DataFrame) -> DataFrame:
    """The edits of ``rows`` (conv, turn, role, text; role and text not null): one row per distinct row,
    with ``copies``, ``letters`` (edits up to and with its first copy; empty if all copies go) and
    ``made`` (initials that these insert or set), ``deleted`` (copies that go besides), ``tail`` and
    ``tail_made`` (insertions behind the last row).

    Rows of a conversation are ordered by turn (null first), then role, then a hash of the text. Blank
    rows and rows whose role and text came before must go. Costs: delete 3, insert or set a role 2, a
    truncated row that stays 1; of the cheapest plans the one whose letters come first.
    """
    ordered = turns(rows).repartitionByRange(*KEY).withColumn("p", F.spark_partition_id())
    placed = stored(ordered, "placed")
    places = _places(placed)
    names = [*KEY, "copies", "blank", "later", "truncated"]

    def plan(group: pa.Table) -> pa.Table:
        group = sorted_group(group)
        p = group.column("p")[0].as_py()
        letters, made, tail, tail_made = [], [], [], []
        for piece in pieces(group):
            vector, state, last = places.get((p, piece.conv), ALONE)
            for kind, (own, roles, state) in zip(piece.kinds, edits(piece.kinds, vector, state)):
                letters.append(own if kind else "")
                made.append(roles)
                tail.append("")
                tail_made.append("")
            if last:
                tail[-1], tail_made[-1] = closing(state)
        gone = pc.subtract(group.column("copies"), pa.array([1 if own else 0 for own in letters], pa.int64()))
        columns = [*(group.column(c) for c in names), gone]
        texts = [pa.array(v, pa.string()) for v in (letters, made, tail, tail_made)]
        return pa.table([*columns, *texts], [*names, "deleted", "letters", "made", "tail", "tail_made"])

    kind = StructType([placed.schema[c] for c in names] + [StructField("deleted", LongType())])
    for name in ("letters", "made", "tail", "tail_made"):
        kind = kind.add(name, StringType())
    return placed.groupBy("p").applyInArrow(plan, kind)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal rows in a batch the first: a row that comes very often need not travel each time."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        at = table.append_column("at", pa.array(range(len(batch)), pa.int64())).group_by(KEY).aggregate([("at", "min")])
        yield batch.take(at.column("at_min").combine_chunks())


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's rows (kind 1), and behind each the text of its copies (kind 2)."""
    texts = marked(rows)
    texts = texts.mapInArrow(_first_copies, texts.schema).withColumn("kind", F.lit(2))
    return plan.withColumn("kind", F.lit(1)).unionByName(texts, allowMissingColumns=True)


def repaired(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired conversations of ``rows`` (conv, turn, role, text): conv; turn, said, mark
    and step (their order; ``said`` is the role before); edit (K, R or I), role, text. An inserted turn
    stands with the row it comes before, or behind which it is the last. Deleted rows are left out."""
    plan = edit_plan(rows) if plan is None else plan
    both = _beside(rows, plan).repartition(*KEY).sortWithinPartitions(*KEY, "kind")
    kind = StructType([both.schema["conv"], both.schema["turn"], StructField("said", StringType()), both.schema["mark"]])
    kind = kind.add("step", IntegerType()).add("edit", StringType()).add("role", StringType()).add("text", StringType())

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    open_row = row
                elif open_row:
                    key = [row[c] for c in KEY]
                    out += [(*key, n, *turn) for n, turn in enumerate(spoken_of(open_row, row["text"]))]
                    open_row = None
            columns = list(zip(*out)) or [()] * 8
            types = [batch.schema.field(c).type for c in KEY] + [pa.int32()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], kind.names)

    return both.mapInArrow(spoken, kind)


def spoken_of(row: dict, text: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what a row of the plan leaves or inserts."""
    role_of = {role[0]: role for role in ROLE.values()}
    for letters, made in ((row["letters"], iter(row["made"])), (row["tail"], iter(row["tail_made"]))):
        for letter in letters:
            if letter == "K":
                yield "K", row["role"], text
            elif letter == "R":
                yield "R", role_of[next(made)], text
            elif letter == "I":
                yield "I", role_of[next(made)], ""


class Tally:
    """What the report says of one conversation, from its rows in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.distinct = conv, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.sha, self.spoken, self.last = hashlib.sha256(), False, None

    def add(self, row: dict) -> None:
        copies, initial, letters = row["copies"], row["role"][:1], row["letters"] + "D" * row["deleted"] + row["tail"]
        if (turn := row["turn"]) is not None:
            self.distinct += not self.turns or self.turns[-1] != turn
            self.turns = [self.turns[0] if self.turns else turn, turn]
        first = 0 if row["blank"] or row["later"] else 1
        self.blank += copies if row["blank"] else 0
        self.duplicate += 0 if row["blank"] else copies - first
        self.truncated += first and row["truncated"]
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.last = initial
        kept = letters.count("K") + letters.count("R")
        self.cost += DELETE * letters.count("D") + INSERT * letters.count("I") + REROLE * letters.count("R")
        self.cost += CUT * kept * row["truncated"]
        self.audit.append(letters)

    def say(self, row: dict, text: str) -> None:
        for _, role, said in spoken_of(row, text):
            self.sha.update(f"{'\n' if self.spoken else ''}{role}:{said}".encode())
            self.spoken = True

    def result(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, int(self.truncated), self.illegal, self.cost)
        return (self.conv, *counts, "".join(self.audit), self.sha.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation of ``convs`` (conv): counts of faults, cost and letters (audit) of the
    repair of ``rows`` (conv, turn, role, text), and a hash of the repaired ``role:text`` lines.

    A conversation without rows has zeros, an empty audit and the hash of nothing; a null conversation
    is one like any other. A hash is of one text, so the rows of a conversation pass through one
    task, in order and one at a time.
    """
    both = _beside(rows, edit_plan(rows)).withColumn("part", F.lit(1))
    heads = convs.select("conv").distinct().withColumn("part", F.lit(0))
    both = heads.unionByName(both, allowMissingColumns=True).repartition("conv")
    both = both.sortWithinPartitions("conv", "part", "turn", "role", "mark", "kind")
    kind = StructType([both.schema["conv"]] + [StructField(c, LongType()) for c in COUNTS])
    kind = kind.add("audit", StringType()).add("repaired_sha256", StringType())

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, open_row, types = None, None, None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], kind.names)

        for batch in batches:
            types = [batch.schema.field("conv").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            found = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    found += [tally.result()] if tally else []
                    tally = Tally(row["conv"])
                elif row["kind"] == 1:
                    tally.add(row)
                    open_row = row
                elif open_row:
                    tally.say(open_row, row["text"])
                    open_row = None
            yield batch_of(found)
        if tally:
            yield batch_of([tally.result()])

    return both.mapInArrow(tallied, kind)
