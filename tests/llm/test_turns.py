import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from eventrate.llm import queries, turns

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest_by_table(signs, entry=0, ends=(0, 3), inserts_at_end=True):
    """Least cost and first letters by a table over all turns and last roles, each entry the best pair."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def insert(row):
        for _ in range(4):
            for role, (cost, letters) in list(row.items()):
                new = (cost + 2, letters + "I")
                row[after[role]] = min(new, row.get(after[role], new))

    row = {entry: (0, "")}
    for initial, fault in zip(signs[::2], signs[1::2]):
        insert(row)
        following = {}
        for role, (cost, letters) in row.items():
            more = fault == "t"
            steps = [(role, cost + 3, "D")]
            if fault != "x":
                steps.append((after[role], cost + 2 + more, "R"))
                if {"u": 2, "a": 3}.get(initial) == after[role]:
                    steps.append((after[role], cost + more, "K"))
                if initial == "s" and role == 0:
                    steps.append((1, cost + more, "K"))
            for to, c, letter in steps:
                new = (c, letters + letter)
                following[to] = min(new, following.get(to, new))
        row = following
    if inserts_at_end:
        insert(row)
    return min((row[r] for r in ends if r in row), default=None)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def summary(rows, conv):
    own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, kinds = set(), []
    for _, _, role, text in own:
        said = text.strip(BLANK)
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    numbers = [r[1] for r in own if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    signs = "".join(
        (r[2][:1] if r[2][:1] in ("s", "u", "a") else "?") + {None: "-", "truncated": "t"}.get(k, "x") for r, k in zip(own, kinds)
    )
    cost, audit = cheapest_by_table(signs)
    lines, at, last = [], 0, 0
    for letter in audit:
        given = "assistant" if last == 2 else "user"
        if letter == "I":
            lines.append(f"{given}:")
        else:
            _, _, role, text = own[at]
            at += 1
            if letter == "D":
                continue
            lines.append(f"{role if letter == 'K' else given}:{text}")
            if letter == "K" and role[:1] == "s":
                last = 1
                continue
        last = 3 if given == "assistant" else 2
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def test_auction_against_a_table_of_best_paths():
    draw = random.Random(1)
    for k in range(1500):
        n = draw.randint(0, 8) if k % 10 else draw.randint(9, 2 * turns.PIECE)
        signs = "".join(draw.choice("suuuaaa?") + draw.choice("----tx") for _ in range(n))
        assert turns.cheapest(signs, turns.START, (turns.START, turns.ASSISTANT), True) == cheapest_by_table(signs), signs
        entry, end = draw.randrange(4), draw.randrange(4)
        assert turns.cheapest(signs, entry, (end,), False) == cheapest_by_table(signs, entry, (end,), False), (signs, entry, end)


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = damaged(rows)
    want = sorted(summary(hurt, c) for c in {r[0] for r in rows})
    got = queries.QUERIES["op12_auction"](spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {x for r in want for x in r[7]} == set("KRDI")


def _rows():
    draw = random.Random(5)
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "A."), (1, None, "user", "A."), (1, 2, "", "B"),
        (2, 5, "system", "S."), (3, 0, "user", "   \t"), (4, 1, "tool", "x." * 100_000), (4, 2, "assistant", "done"),
        (5, 1, "system", "S."), (5, 2, "system", "S."), (5, 9, "system", "T."), (6, 1, "user", "one\ntwo?\n"), (6, 2, "assistant", "\x0b"),
    ]
    for conv in range(10, 60):
        for turn in range(draw.randint(1, 12)):
            rows.append((conv, draw.choice([turn, turn, None]), draw.choice(["user", "assistant", "system", "User"]), draw.choice(["Yes.", "no", "", "What?"])))
    for conv, size in ((70, 500), (71, turns.PIECE), (72, turns.PIECE + 1), (73, 2 * turns.PIECE)):
        rows += [(conv, t, draw.choice(["user", "assistant"]), draw.choice([f"Text {t}.", f"cut {t}", "again."])) for t in range(size)]
    rows += [(74, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(400)]
    return rows


def _summaries(df):
    return sorted((tuple(r) for r in turns.summarise(turns.repair(df)).collect()), key=repr)


def test_odd_and_long_conversations(spark):
    rows = _rows()
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = sorted((summary(filled, c) for c in {r[0] for r in rows}), key=repr)
    names = ("copy", "fault", "place", "edit", "was", "kind", "own")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in names}).repartition(6)
    assert _summaries(df) == want
    assert _summaries(df.limit(0)) == []
    hurt = sorted((summary(damaged(rows), c) for c in {r[0] for r in damaged(rows)}), key=repr)
    assert _summaries(turns.damage(df)) == hurt


def test_edits_make_legal_conversations(spark):
    rows = turns.repair(spark.createDataFrame(_rows(), SCHEMA)).orderBy("conv_id", "place").collect()
    texts, count = {}, {}
    for r in rows:
        count[r.conv_id] = count.get(r.conv_id, 0) + 1
        texts.setdefault(r.conv_id, "")
        if r.edit != "D":
            texts[r.conv_id] += r.role[:1]
            assert r.edit != "I" or (r.text, r.turn, r.was) == ("", None, None)
    assert all(re.fullmatch("(s?(ua)+)?", t) for t in texts.values())


def test_conversation_without_turns_left(spark, tmp_path):
    # crc32("22:1") and others of this list are 0 modulo 20: every turn is dropped.
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Hi.") for c, t in gone]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_auction"](spark, str(tmp_path)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in got) == sorted((c, 0, 0, 0, 0, 0, 0, "", empty) for c in {c for c, _ in gone})


@pytest.mark.parametrize("size", [300])
def test_pieces_of_a_long_conversation_are_let_go(size):
    own = turns._Repair(1)
    held = 0
    for t in range(size):
        list(own.add((t, ("user", "assistant")[t % 2], f"T{t}.", None)))
        held = max(held, len(own.pieces))
    assert held <= 2
