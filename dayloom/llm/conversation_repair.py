"""Cheapest repair of the turn structure of conversations by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables

#: Rows that one search runs over; longer conversations are chains of such blocks.
BLOCK = 32
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_GONE, _CUT = 2, 1              # faults of a row: has to go; its text is truncated

# What a repaired conversation holds so far: nothing, a system row, ends with a user or an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_NEXT = (USER, USER, ASSISTANT, USER)       # after an inserted or reroled row
_REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
#: Inserts that complete a conversation, and their cost.
_LAST = ("", "II", "I", "")
_LAST_COST = tuple(INSERT * len(x) for x in _LAST)
_CLASSES, _NEVER = "sua?", float("inf")
_LEGAL = {"su", "ua", "au"}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows with planted faults, by the check of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties the text, 2 removes its sentence ends, 3 repeats
    the row, 4 sets the role user.  Nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    changed = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


@lru_cache(maxsize=1 << 14)
def _floors(marks: bytes) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """What the rows from each position on cost at least in any state, and whether a system row is among them.

    Rows that have to go cost a deletion, truncated ones their penalty; rows of no
    usable role one more edit each, and so do disjoint pairs of neighbours of one role.
    """
    floor, system = [0], [False]
    pairs, row = [(0, "")], 0       # of the suffix: best number of pairs, role that could pair; by usable rows
    for mark in reversed(marks):
        role, fault = _CLASSES[mark >> 2], mark & 3
        fixed = floor[-1] - INSERT * pairs[-1][0]
        if fault == _GONE:
            fixed += DELETE
        else:
            fixed += fault
            best = pairs[-1][0]
            if role in "ua":
                if len(pairs) > 1 and pairs[-1][1] == role:
                    best = max(best, pairs[-2][0] + 1)
                pairs.append((best, role))
            else:
                fixed += INSERT
                pairs.append((best, ""))
        floor.append(fixed + INSERT * pairs[-1][0])
        system.append(system[-1] or (role == "s" and fault != _GONE))
    return tuple(reversed(floor)), tuple(reversed(system))


@lru_cache(maxsize=1 << 16)
def search(marks: bytes, start: int, ends: tuple[float, ...]) -> tuple[int, str, int] | None:
    """Cost, edits and last state of the cheapest way through a block; ``ends`` is the cost from each state after it.

    Each mark is a role class and a fault.  The search goes depth first through
    Delete, Insert, Keep, Rerole under a bound on the whole cost, which grows to
    the least cost that went beyond it; states that failed with as much left are
    not entered again.  The first way found is the cheapest, and of equally cheap
    ones the first in the order of the edits' initials.  Inserts after the last row belong to
    what follows.  Before a row that has to go nothing is inserted: after it the
    same insert costs the same and comes later in that order.
    """
    n, (floor, system) = len(marks), _floors(marks)
    low = [min(ends[r] for r in reach) for reach in _REACH]
    only_deletes = ends[USER] == ends[ASSISTANT] == _NEVER

    def least(i: int, q: int) -> float:
        if i == n:
            return ends[q]
        if only_deletes:
            return DELETE * (n - i - (q == START and ends[SYSTEM] < _NEVER)) + low[q]
        return floor[i] - (REROLE if q == START and system[i] else 0) + low[q]

    bound, edits = least(0, start), []
    while bound < _NEVER:
        failed: dict[tuple[int, int], float] = {}
        beyond = _NEVER

        def walk(i: int, q: int, left: float) -> int:
            nonlocal beyond
            need = least(i, q)
            if need > left:
                beyond = min(beyond, need - left)
                return -1
            if i == n:
                return q
            if failed.get((i, q), -1) >= left:
                return -1
            role, fault = _CLASSES[marks[i] >> 2], marks[i] & 3
            ways = [("D", i + 1, q, DELETE)]
            if fault != _GONE:
                ways.append(("I", i, _NEXT[q], INSERT))
                if role in _KEEP[q]:
                    ways.append(("K", i + 1, _KEEP[q][role], fault))
                ways.append(("R", i + 1, _NEXT[q], REROLE + fault))
            for letter, at, state, cost in ways:
                edits.append(letter)
                end = walk(at, state, left - cost)
                if end >= 0:
                    return end
                edits.pop()
            failed[i, q] = left
            return -1

        end = walk(0, start, bound)
        if end >= 0:
            return int(bound), "".join(edits), end
        bound += beyond
    return None


@lru_cache(maxsize=1 << 14)
def block_costs(marks: bytes) -> tuple[int, ...]:
    """Least cost through a block from each state to each state, -1 where there is no way."""
    out = []
    for q in range(4):
        for r in range(4):
            found = search(marks, q, tuple(0 if s == r else _NEVER for s in range(4)))
            out.append(-1 if found is None else found[0])
    return tuple(out)


_KEY = ["conv_id", "turn", "role", "h"]
_BLOCK_FIELDS = ("conv_id long, turn long, role string, h binary, seq int, marks binary, blank long, duplicate long, truncated long, "
                 "illegal long, first string, last string, turns long, least long, last_turn long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.strip().split(" ") for f in ddl.split(","))])


def _cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows as blocks of one conversation: marks, counts of faults, and what joins them to their neighbours."""
    block: dict | None = None
    before: tuple | None = None
    seq = 0
    for row in rows:
        key = tuple(row[c] for c in _KEY)
        if block is None or block["conv_id"] != row["conv_id"] or len(block["marks"]) == BLOCK:
            if block is not None:
                yield block
            seq += 1
            block = {**{c: row[c] for c in _KEY}, "seq": seq, "marks": b"", "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                     "first": row["initial"], "last": None, "turns": 0, "least": None, "last_turn": None}
        again = not row["blank"] and (row["again"] or before == key)
        fault = _GONE if row["blank"] or again else _CUT if row["cut"] else 0
        block["blank"] += row["blank"]
        block["duplicate"] += again
        block["truncated"] += fault == _CUT
        if block["last"] is not None:
            block["illegal"] += block["last"] + row["initial"] not in _LEGAL
        block["last"] = row["initial"]
        if row["turn"] is not None:
            block["turns"] += row["turn"] != block["last_turn"]
            block["least"] = row["turn"] if block["least"] is None else block["least"]
            block["last_turn"] = row["turn"]
        block["marks"] += bytes([_CLASSES.index(row["initial"]) << 2 | fault])
        before = key
    if block is not None:
        yield block


def _backwards(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks from last to first, each with the cost of all that follows it from each state, and its own from the start."""
    conv, value, some = None, _LAST_COST, False
    for block in blocks:
        if not some or block["conv_id"] != conv:
            conv, value, some = block["conv_id"], _LAST_COST, True
        costs = block.pop("costs")
        ends = value
        value = tuple(min(costs[4 * q + r] + ends[r] for r in range(4) if costs[4 * q + r] >= 0) for q in range(4))
        yield {**block, "ends": list(ends), "total": value[START]}


def _edited(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks with their edits and last state for each first state."""
    for block in blocks:
        ends = tuple(block.pop("ends"))
        least = min(ends)
        found = [search(block["marks"], q, tuple(e - least for e in ends)) for q in range(4)]
        yield {**block, "edits": [f[1] for f in found], "exits": [f[2] for f in found]}


class _Repair:
    """One conversation as its blocks and rows come in, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.least, self.last_turn, self.initial = 0, None, None, None
        self.cost, self.state, self.exit = 0, START, START
        self.audit: list[str] = []
        self.todo: deque[str] = deque()
        self.digest, self.lines = hashlib.sha256(), 0

    def block(self, b: dict) -> None:
        for name in self.counts:
            self.counts[name] += b[name]
        if self.initial is not None:
            self.counts["illegal"] += self.initial + b["first"] not in _LEGAL
        else:
            self.cost = b["total"]
        self.initial = b["last"]
        self.turns += b["turns"] - (b["least"] is not None and b["least"] == self.last_turn)
        self.least = b["least"] if self.least is None else self.least
        self.last_turn = b["last_turn"] if b["last_turn"] is not None else self.last_turn
        edits = b["edits"][self.exit]
        self.exit = b["exits"][self.exit]
        self.audit.append(edits)
        self.todo.extend(edits)

    def _add(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _made(self, text: str) -> None:
        self.state = _NEXT[self.state]
        self._add(_ROLE[self.state], text)

    def row(self, role: str, text: str) -> None:
        while (edit := self.todo.popleft()) == "I":
            self._made("")
        if edit == "K":
            self.state = _KEEP[self.state][role[0]]
            self._add(role, text)
        elif edit == "R":
            self._made(text)

    def result(self) -> dict:
        last = _LAST[self.exit]
        for _ in last:
            self._made("")
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit) + last,
                "repaired_sha256": self.digest.hexdigest()}


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    one: _Repair | None = None
    for row in rows:
        if one is None or one.conv_id != row["conv_id"]:
            if one is not None:
                yield one.result()
            one = _Repair(row["conv_id"])
        if row["kind"] == 1:
            one.block(row)
        elif row["kind"] == 2:
            one.row(row["role"], row["text"])
    if one is not None:
        yield one.result()


def _through(df: DataFrame, step, ddl: str) -> DataFrame:
    schema = _schema(ddl)
    return df.mapInArrow(lambda batches: _batches(step(_rows(batches)), schema), ddl)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: key, class of the role, faults; ``again`` if an earlier turn has the same role and text.

    The first turn of each role and text comes from a pre-aggregated minimum.
    Equal rows of one turn are told apart where they are sorted.
    """
    light = rows.where("not dropped").select(
        *_KEY, F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?").alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    seen = (light.where("not blank").groupBy(F.col("conv_id").alias("seen_id"), F.col("role").alias("seen_role"), F.col("h").alias("seen_h"))
            .agg(F.count("*").alias("n"), F.count("turn").alias("with_turn"), F.min("turn").alias("first_turn")).where("n > 1"))
    again = F.when(F.col("n") > F.col("with_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    return (light.join(seen, F.expr("conv_id <=> seen_id and role = seen_role and h = seen_h"), "left")
            .select(*light.columns, F.coalesce(again, F.lit(False)).alias("again")))


def conversation_repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, dropped): its faults and the cheapest repair.

    Rows of a conversation are ordered by turn (nulls first), then role, then
    SHA-256 of the text.  The first fault of a row counts: ``blank`` has no other
    than white space, ``duplicate`` has the role and text of an earlier row,
    ``truncated`` does not end in one of ``.!?``.  ``illegal`` are neighbours whose
    role initials are not su, ua or au; ``gaps`` are missing turns.  Edits are
    Keep (free), Rerole to user or assistant (2), Delete (3; blank and duplicate
    rows have to go) and Insert of an empty user or assistant row (2); truncated
    rows that stay add 1.  ``audit`` has the initials of the cheapest edits after
    which the roles are ``(s?(ua)+)?``; of equally cheap ones the least.
    ``repaired_sha256`` is that of the repaired ``role:text``, by lines.

    Keys without texts are sorted by range, so that a conversation that holds a
    third of all rows is dealt out; each run of up to ``BLOCK`` rows is searched
    between all states.  Costs go backwards over the blocks of a conversation, the
    search then finds each block's edits for each first state, and one pass in
    order over blocks and texts picks them and feeds the hash row by row: a
    SHA-256 of one conversation is one task's work, in bounded memory but for the
    audit itself.

    A null id is a conversation of its own; null role and text are one space, a
    role of other or no initial can not be kept.  Repeated rows are duplicates.
    A conversation with no rows left has zeros, an empty audit and the hash of
    nothing.  No rows give no rows; further columns are not looked at.
    """
    tables = Tables(rows.sparkSession)
    keyed = rows.withColumn("h", F.unhex(F.sha2("text", 256)))
    order = [*_KEY, "again"]
    lines = _marked(keyed).repartitionByRange(*_KEY).sortWithinPartitions(*order)
    blocks = _through(lines, lambda r: ({**b, "costs": list(block_costs(b["marks"]))} for b in _cut(r)), f"{_BLOCK_FIELDS}, costs array<int>")
    back = [F.col(c).desc_nulls_last() for c in (*_KEY[1:], "seq")]
    valued = _through(blocks.repartition("conv_id").sortWithinPartitions("conv_id", *back), _backwards, f"{_BLOCK_FIELDS}, ends array<int>, total long")
    edited = tables.keep(_through(valued.repartition(*_KEY, "seq"), _edited, f"{_BLOCK_FIELDS}, total long, edits array<string>, exits array<int>"), "blocks")

    no = lambda *names: (F.lit(None).cast(edited.schema[n].dataType).alias(n) for n in names)
    further = [c for c in edited.columns if c not in (*_KEY, "marks")]
    kept = F.col("dropped") == F.lit(False)
    texts = keyed.select("conv_id", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, F.col("role")).alias("role"),
                         F.when(kept, F.col("h")).alias("h"), F.when(kept, 2).otherwise(0).alias("kind"),
                         F.when(kept, F.col("text")).alias("text"), *no(*further))
    union = edited.select(*_KEY, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), *further).unionByName(texts)
    ordered = union.repartition("conv_id").sortWithinPartitions(*_KEY, "kind", "seq")
    return _through(ordered, _repaired, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                                        "repaired_sha256 string")


def conversation_digest(rows: DataFrame) -> DataFrame:
    return conversation_repair(damaged(rows))
