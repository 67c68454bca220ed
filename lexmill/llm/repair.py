"""Conversation structure repair: the cheapest edits that make a conversation's roles s?(ua)+, or leave nothing.

A dynamic program over the retained turns. A turn that is retained, kept or reroled, is reached from the last one that was
retained before it, or from none; all turns between go. With D(j), the price of deleting the first j turns, the price of a gap is a
difference of two values of D, so it is enough to hold, for each state of the last retained turn (none, s, u, a), the
running minimum of price less D. The pair of roles says what must be inserted between. Of edits equally cheap those count
whose initials (D, I, K, R) are ASCII-least. That order needs no strings: two states' initials so far, ending in an
edit of the same turn, can't be each other's beginning, so how they compare is decided once and for all, and a rank of
four states carries it along. A turn costs a few steps and four bytes.

A conversation is the rows of one conv_id (null is one too) by turn, nulls first, rows of equal turn by role and text's
digest. Only narrow rows (no texts) are brought together by conversation, sorted, and pass in a stream; the texts meet
their edits by row number, whatever conversation they are in. Null roles and texts are one space. Only the columns conv_id,
turn, role and text are read. Empty tables give none. Equal texts are those of equal md5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Edits that go out in one Arrow batch.
BATCH = 1 << 16

_EDITS = (
    "conv_id long, id long, step long, edit string, role string, before string, "
    "audit string, ending array<string>, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
)
_ARROW = {"conv_id": pa.int64(), "id": pa.int64(), "step": pa.int64(), "edit": pa.string(), "role": pa.string(), "before": pa.string(), "audit": pa.string(), "ending": pa.list_(pa.string())}
_ARROW |= {c: pa.int64() for c in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal")}


def inserted(state: int, role: int) -> list[int]:
    """The roles that must stand between a retained turn of ``state`` and one of ``role``."""
    if role == USER:
        return [ASSISTANT] if state == USER else []
    return [] if state == USER else [USER]


class Repair:
    """One conversation, its turns given in order by ``add``; ``audit`` then has the cheapest edits."""

    def __init__(self) -> None:
        self.price: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.steps: list[tuple | None] = []
        self.deleted = 0

    def add(self, initial: str, faulty: bool, truncated: bool) -> None:
        """A turn whose role begins with ``initial``; ``faulty``: it has to go."""
        self.deleted += DELETE
        if faulty:
            self.steps.append(None)
            return
        own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
        price, rank = self.price, self.rank
        best = [None if p is None else (p, rank[s], "D", s) for s, p in enumerate(price)]
        extra = TRUNCATED * truncated - DELETE
        changed = False
        for role in (SYSTEM, USER, ASSISTANT) if own == SYSTEM else (USER, ASSISTANT):
            edit, cost = ("K", KEEP) if role == own else ("R", REROLE)
            for state in (NONE,) if role == SYSTEM else range(4):
                if price[state] is None:
                    continue
                n = 0 if role == SYSTEM else len(inserted(state, role))
                found = (price[state] + n * INSERT + cost + extra, rank[state], "I" * n + edit, state)
                if best[role] is None or found < best[role]:
                    best[role], changed = found, True
        if not changed:
            self.steps.append(None)
            return
        self.price = [b and b[0] for b in best]
        order = sorted((b[1:3], s) for s, b in enumerate(best) if b)
        for r, (_, s) in enumerate(order):
            self.rank[s] = r
        self.steps.append(tuple(b and (b[2], b[3]) for b in best))

    def edits(self) -> tuple[int, list[tuple[str, int]], list[int]]:
        """The price, the edits of each turn ("D", or inserts and the edit, with the state it ends in), what is inserted behind all."""
        ends = {NONE: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
        _, _, _, state = min((p + INSERT * len(ends[s]), self.rank[s], "I" * len(ends[s]), s) for s, p in enumerate(self.price) if p is not None)
        cost, ending, found = self.price[state] + INSERT * len(ends[state]) + self.deleted, ends[state], []
        for step in reversed(self.steps):
            letters, previous = step[state] if step else ("D", state)
            found.append((letters, state))
            state = previous
        return cost, found[::-1], ending


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted narrow rows in, a row of each turn's edit and one (id null) of each conversation out."""
    out: dict[str, list] = {c: [] for c in _ARROW}

    def put(**cells) -> None:
        for c, column in out.items():
            column.append(cells.get(c))

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, _ARROW[c]) for c, v in out.items()], names=list(_ARROW))
        for column in out.values():
            column.clear()
        return made

    def finish() -> Iterator[pa.RecordBatch]:
        cost, edits, ending = repair.edits()
        step, audit = 0, []
        for own, (letters, state) in zip(ids, edits, strict=True):
            audit.append(letters)
            step += len(letters)
            kind = letters[-1]
            before = ROLES[USER if state == ASSISTANT else ASSISTANT] if len(letters) > 1 else None
            put(conv_id=conv, id=own, step=step, edit=kind, role=ROLES[state] if kind == "R" else None, before=before)
            if len(out["id"]) >= BATCH:
                yield batch()
        audit += "I" * len(ending)
        turns = (last - first + 1 - distinct) if distinct else 0
        put(conv_id=conv, audit="".join(audit), ending=[ROLES[r] for r in ending], cost=cost, step=step, gaps=turns, **faults)

    conv, repair = object(), None
    for rows in batches:
        for own, c, turn, initial, blank, truncated, key in zip(*(rows.column(k).to_pylist() for k in ("id", "conv_id", "turn", "initial", "blank", "truncated", "key")), strict=True):
            if repair is None or c != conv:
                if repair is not None:
                    yield from finish()
                conv, repair, seen, ids = c, Repair(), set(), []
                faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                first = last = None
                distinct, before = 0, None
            repeated = key in seen
            seen.add(key)
            fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
            if fault:
                faults[fault] += 1
            faults["illegal"] += before is not None and before + initial not in LEGAL
            before = initial
            if turn is not None and turn != last:
                first, last, distinct = (turn if first is None else first), turn, distinct + 1
            ids.append(own)
            repair.add(initial, fault in ("blank", "duplicate"), fault == "truncated")
    if repair is not None:
        yield from finish()
    if out["id"]:
        yield batch()


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of conversations stored with a row number each: id, conv_id, turn, role, text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role"), filled("text"))
    return staged(rows.select(F.monotonically_increasing_id().alias("id"), "*"), "repair-rows")


def edits(stored: DataFrame) -> DataFrame:
    """A row for each turn of ``numbered`` rows: id, step (its place in the audit, from 1), edit (K, R, D), role (if reroled) and before (a role
    inserted in front); and one with a null id for each conversation: audit, ending (roles inserted at the end), cost and faults."""
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    narrow = stored.select(
        "id", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (ended == "").alias("blank"),
        (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated"), key.alias("key"), "role",
    )
    placed = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key", "id").drop("role")
    return staged(placed.mapInArrow(_edits, _EDITS), "repair-edits")


def repaired(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations' turns: conv_id, step (their order), role, text, edit (K, R or I)."""
    turn = lambda step, role, text, edit: F.struct(step.alias("step"), role.alias("role"), text.alias("text"), F.lit(edit).alias("edit") if isinstance(edit, str) else edit.alias("edit"))
    kept = found.where("id IS NOT NULL AND edit <> 'D'").select("id", "step", "edit", F.col("role").alias("new"), "before")
    rows = stored.join(kept, "id")
    own = turn(F.col("step"), F.coalesce("new", "role"), F.col("text"), F.col("edit"))
    with_new = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(turn(F.col("step") - 1, F.col("before"), F.lit(""), "I"), own))
    behind = found.where("id IS NULL AND size(ending) > 0").select("conv_id", "step", F.posexplode("ending").alias("k", "role"))
    behind = behind.select("conv_id", (F.col("step") + F.col("k") + 1).alias("step"), "role", F.lit("").alias("text"), F.lit("I").alias("edit"))
    return rows.select("conv_id", F.explode(with_new).alias("x")).select("conv_id", "x.*").union(behind)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted repaired turns, one conversation after the other, no text held longer than its batch."""
    convs, digests = [], []
    conv, running = object(), None
    for rows in batches:
        for c, role, text in zip(*(rows.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if running is None or c != conv:
                if running is not None:
                    convs.append(conv)
                    digests.append(running.hexdigest())
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        if len(convs) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests)], names=["c", "sha"])
            convs, digests = [], []
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*convs, conv], pa.int64()), pa.array([*digests, running.hexdigest()])], names=["c", "sha"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The seeded damage: rows dropped, emptied, without their stops, repeated, or given the role user; nulls are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")

    def when(n: int, then: Column, otherwise: Column) -> Column:
        return F.when(F.col("kind") == n, then).otherwise(otherwise)

    text = when(1, F.lit(""), when(2, F.translate("text", ".!?", ""), F.col("text")))
    rows = rows.select("conv_id", "turn", when(4, F.lit("user"), F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), when(3, F.lit(2), F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def repairs(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired: its faults, price and audit, and the digest of what it became."""
    stored = numbered(damaged(conversations))
    found = edits(stored)
    sorted_turns = repaired(stored, found).repartition("conv_id").sortWithinPartitions("conv_id", "step").select("conv_id", "role", "text")
    hashed = sorted_turns.mapInArrow(_hashes, "c long, sha string")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    summary = found.where("id IS NULL").select(F.col("conv_id").alias("k"), *counts, "audit")
    out = conversations.select(F.col("conv_id").cast("long")).distinct()
    out = out.join(summary, F.col("conv_id").eqNullSafe(F.col("k")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
