"""Repair of the turn structure of conversations: cheapest edits by an auction for shortest paths.

A conversation of n turns is a lattice of nodes (turns read, last role).  Arcs keep, re-role or delete the next
turn, or insert one; a legal conversation is a path to the end whose roles read ``(s?(ua)+)?``.  The auction
(Bertsekas) holds a price for every node, never above the cost of an arc plus the price behind it.  It grows
one path from the origin: where the best arc is tight the path is extended along it, else the price of its
last node rises to the best arc and the path is contracted by that node.  All numbers are integers, so it ends.  With
the end reached, the origin's price is the least cost, and an arc lies on some cheapest path only if it is
tight; of these paths the one whose letters come first in ASCII is read off from the front.

Turns are ordered by ``turn`` (NULL first), then role, then text.  A NULL role or text counts as one space; a NULL id is
a conversation of its own.  Conversations come to a task in order and are read in pieces of ``PIECE`` turns, so that
long ones are never held whole; what is kept of them are at most four edit sequences as far back as they still differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE = 16  # turns solved as one lattice
CACHED = 50_000  # lattices whose solution a worker remembers
ROWS_OUT = 10_000
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs of the edits; an undeleted truncated turn costs one more.
REROLED, DELETED, INSERTED, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends with
AFTER = (USER, USER, ASSISTANT, USER)  # the only role that may be inserted or given next
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANKS = "\t\n\x0b\x0c\r "

EDITS = "conv_id {id}, place bigint, edit string, turn bigint, role string, text string, was string, fault string"


# --- one lattice -----------------------------------------------------------------------


def _arcs(signs: str, last: bool) -> Callable[[int], list[tuple[str, int, int]]]:
    """Arcs (letter, node, cost) out of a node ``4 * turns read + role``; inserts behind the end only in the last piece."""
    size = len(signs) // 2

    def out(node: int) -> list[tuple[str, int, int]]:
        place, role = divmod(node, 4)
        following = AFTER[role]
        found = []
        if place < size:
            initial, fault = signs[2 * place], signs[2 * place + 1]
            found.append((DELETE, node + 4, DELETED))
            if fault in "-t":
                more = TRUNCATED if fault == "t" else 0
                if initial == "ua"[following - USER]:
                    found.append((KEEP, node + 4 - role + following, more))
                elif initial == "s" and role == START:
                    found.append((KEEP, node + 4 + SYSTEM, more))
                found.append((REROLE, node + 4 - role + following, REROLED + more))
        if place < size or last:
            found.append((INSERT, node - role + following, INSERTED))
        return found

    return out


@lru_cache(CACHED)
def cheapest(signs: str, entry: int, ends: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """Cost and letters of the first of the cheapest paths from role ``entry`` to one of the roles ``ends``.

    ``signs`` holds two characters a turn: the role's initial (``?`` for any but s, u, a) and the fault (``-``
    none, ``t`` truncated, ``x`` must go).  None if there is no such path.
    """
    size = len(signs) // 2
    turns = [signs[i:i + 2] for i in range(0, len(signs), 2)]
    # Nothing leads back to the start, and to the system's turn only one that is kept in front.
    system = SYSTEM if entry == SYSTEM or entry == START and ("s-" in turns or "st" in turns) else None
    ends = tuple(r for r in ends if r in (entry, system, USER, ASSISTANT))
    if not ends:
        return None
    goals = {4 * size + role for role in ends}
    arcs = _arcs(signs, last)
    # Every path pays at least this much behind a node: prices that fit all arcs and spare the auction many rises.
    floor = [0] * (size + 1)
    for i in range(size - 1, -1, -1):
        floor[i] = floor[i + 1] + {"-": 0, "t": TRUNCATED, "x": DELETED}[signs[2 * i + 1]]
    limit = (DELETED + INSERTED * 2 + TRUNCATED) * (size + 2)  # dearer than any path that exists
    prices: dict[int, int] = {}
    ways: dict[int, list[tuple[str, int, int]]] = {}

    def price(node: int) -> int:
        return prices.get(node, floor[node // 4])

    path = [entry]
    while path[-1] not in goals:
        node = path[-1]
        if node not in ways:
            ways[node] = arcs(node)
        best, to = min(((cost + price(nxt), nxt) for _, nxt, cost in ways[node]), default=(limit + 1, -1))
        if price(node) >= best:
            path.append(to)
            continue
        prices[node] = best
        if len(path) > 1:
            path.pop()
        elif best > limit:
            return None

    @lru_cache(None)
    def tight(node: int) -> tuple[str, int] | None:
        """First letter and next node of the tight path to a goal."""
        if node in goals and price(node) == 0:
            return "", node
        for letter, nxt, cost in sorted(arcs(node)):
            if price(node) == cost + price(nxt) and tight(nxt):
                return letter, nxt
        return None

    letters, node = [], entry
    while node not in goals:
        letter, node = tight(node)
        letters.append(letter)
    return price(entry), "".join(letters)


def role_after(letters: str, signs: str, role: int) -> int:
    """Last role of the repaired conversation behind a piece."""
    place = 0
    for letter in letters:
        if letter == KEEP and signs[2 * place] == "s":
            role = SYSTEM
        elif letter != DELETE:
            role = AFTER[role]
        place += letter != INSERT
    return role


# --- a stream of turns -----------------------------------------------------------------


class _Repair:
    """Edits of one conversation whose turns come piece by piece."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.place, self.role = conv_id, 0, START
        self.turns: list[tuple] = []  # turns of the piece being read
        self.pieces: list[tuple[list[tuple], str]] = []  # pieces on whose edits the candidates still differ
        self.candidates: dict[int, tuple[int, list[str]]] = {START: (0, [])}

    def add(self, turn: tuple) -> Iterator[tuple]:
        if len(self.turns) == PIECE:
            yield from self._solve(last=False)
        self.turns.append(turn)

    def end(self) -> Iterator[tuple]:
        yield from self._solve(last=True)

    def _solve(self, last: bool) -> Iterator[tuple]:
        signs = "".join(_sign(t) for t in self.turns)
        found: dict[int, tuple[int, list[str]]] = {}
        # Letters of a piece end with the last turn read, so comparing pieces in a row compares the whole sequences.
        for goal in ((START, ASSISTANT),) if last else ((r,) for r in range(4)):
            options = [
                (cost + way[0], [*before, way[1]])
                for role, (cost, before) in self.candidates.items() if (way := cheapest(signs, role, goal, last))
            ]
            if options:
                found[goal[0]] = min(options)
        self.candidates = _hopeful(found)
        self.pieces.append((self.turns, signs))
        self.turns = []
        while self.pieces:
            first = {letters[0] for _, letters in self.candidates.values()}
            if len(first) > 1:
                return
            yield from self._edits(*self.pieces.pop(0), first.pop())
            for _, letters in self.candidates.values():
                del letters[0]

    def _edits(self, turns: list[tuple], signs: str, letters: str) -> Iterator[tuple]:
        at = 0
        for letter in letters:
            given = ROLE.get(AFTER[self.role])
            if letter == INSERT:
                row = (self.conv_id, self.place, letter, None, given, "", None, None)
            else:
                turn, role, text, fault = turns[at]
                row = (self.conv_id, self.place, letter, turn, given if letter == REROLE else role, text, role, fault)
            self.role = role_after(letter, signs[2 * at:2 * at + 2], self.role)
            at += letter != INSERT
            self.place += 1
            yield row


def _hopeful(found: dict[int, tuple[int, list[str]]]) -> dict[int, tuple[int, list[str]]]:
    """Candidates that may still win or tie.

    From the assistant's turn everything goes on as from another one after a few edits at most: an insertion leads to the
    user's turn, and a system turn that only the start could keep is deleted.  The user's turn gets there by an insertion.
    """
    inf = float("inf")
    user, assistant = (found[r][0] if r in found else inf for r in (USER, ASSISTANT))
    most = {START: assistant + DELETED, SYSTEM: assistant, USER: assistant + INSERTED, ASSISTANT: user + INSERTED}
    return {r: f for r, f in found.items() if f[0] <= most[r]}


def _sign(turn: tuple) -> str:
    _, role, _, fault = turn
    initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return initial + {None: "-", "truncated": "t"}.get(fault, "x")


def faults(conversations: DataFrame) -> DataFrame:
    """Turns with their first ``fault``: blank, duplicate (of an earlier turn's role and text), truncated, or NULL."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    said = F.trim(F.col("text"), F.lit(BLANKS))
    same = Window.partitionBy("conv_id", F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256))
    return rows.withColumn("copy", F.row_number().over(same.orderBy(F.asc_nulls_first("turn")))).select(
        "conv_id", "turn", "role", "text",
        F.when(said == "", "blank").when(F.col("copy") > 1, "duplicate")
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"),
    )


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation (``conv_id``, ``turn``, ``role``, ``text``), in order.

    One row per edit: ``place`` counts edits from 0; ``edit`` is K, R, D or I; ``turn``, ``text`` and ``was`` (role before)
    are those of the turn, NULL, empty and NULL for an inserted one; ``role`` is the role after the edit.  The repaired
    conversation is the rows but those of ``edit`` D.  Rows of one conversation stand in order in one partition, with a duplicate
    behind its original.  Other columns of the table, whatever their names, are left out; an empty table gives no rows.
    """
    ordered = faults(conversations).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text", F.expr("fault = 'duplicate'")
    )
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def edits() -> Iterator[tuple]:
            nonlocal schema
            current = None
            for batch in batches:
                schema = schema or pa.schema([
                    ("conv_id", batch.schema.field(0).type), ("place", pa.int64()), ("edit", pa.string()),
                    ("turn", pa.int64()), *[(c, pa.string()) for c in ("role", "text", "was", "fault")],
                ])
                for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                    if current is None or current.conv_id != conv_id:
                        if current:
                            yield from current.end()
                        current = _Repair(conv_id)
                    yield from current.add(tuple(turn))
            if current:
                yield from current.end()

        held: list[tuple] = []
        for row in edits():
            held.append(row)
            if len(held) == ROWS_OUT:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return ordered.mapInArrow(run, EDITS.format(id=kind))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


SUMMARY = (
    "conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Summary:
    """Counts and digest of the edits of one conversation, which are read once."""

    def __init__(self, conv_id) -> None:
        import hashlib

        self.conv_id, self.digest = conv_id, hashlib.sha256()
        self.fault = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.before = None
        self.audit: list[str] = []
        self.lines = 0

    def add(self, edit: str, turn: int | None, role: str, text: str, was: str | None, fault: str | None) -> None:
        self.audit.append(edit)
        if edit != INSERT:
            if fault:
                self.fault[fault] += 1
            if self.before is not None and (self.before, was[:1]) not in LEGAL:
                self.illegal += 1
            self.before = was[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
        self.cost += {KEEP: 0, REROLE: REROLED, DELETE: DELETED, INSERT: INSERTED}[edit]
        if edit != DELETE:
            self.cost += TRUNCATED * (fault == "truncated")
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (
            self.conv_id, gaps, *self.fault.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()
        )


def summarise(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s rows, straight behind it: faults, cost, letters and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, schema = None, [], None
        for batch in batches:
            schema = schema or pa.schema([
                ("conv_id", batch.schema.field(0).type),
                *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                ("audit", pa.string()), ("repaired_sha256", pa.string()),
            ])
            for conv_id, _, *edit in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current.conv_id != conv_id:
                    if current:
                        done.append(current.row())
                    current = _Summary(conv_id)
                current.add(*edit)
            if len(done) >= ROWS_OUT:
                yield _batch(done, schema)
                done = []
        if current:
            yield _batch([*done, current.row()], schema)

    return edits.mapInArrow(run, SUMMARY.format(id=edits.schema["conv_id"].dataType.simpleString()))


def damage(conversations: DataFrame) -> DataFrame:
    """A fifth of all turns damaged, by crc32 of ``conv_id:turn`` modulo 20 (NULL: one space).

    0 drops the turn, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", text["conv_id"], text["turn"]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
