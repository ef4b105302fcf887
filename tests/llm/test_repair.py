"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from labelloom.llm import repair

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def solve(rows):
    """The least (cost, audit) by Dijkstra over rows done and the pattern's state, and the repaired lines."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.strip(SPACES)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, row, state, lines = heapq.heappop(heap)
        if (row, state) in done:
            continue
        done.add((row, state))
        if row == len(rows) and state in (0, 3):
            break
        for name, initial in (("user", "u"), ("assistant", "a")):
            if (initial, state) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", row, NEXT[initial, state], (*lines, f"{name}:")))
        if row < len(rows):
            _, _, role, text = rows[row]
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, state, lines))
            if faults[row] not in ("blank", "duplicate"):
                extra = faults[row] == "truncated"
                for name, initial in (("user", "u"), ("assistant", "a")):
                    if (initial, state) in NEXT:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", row + 1, NEXT[initial, state], (*lines, f"{name}:{text}")))
                if (role[:1], state) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", row + 1, NEXT[role[:1], state], (*lines, f"{role}:{text}")))
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[1] is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") or len(a) != 1 for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(rows):
    left = damage(rows)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    return {conv: solve(sorted((r for r in left if r[0] == conv), key=order)) for conv in {r[0] for r in rows}}


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["Hi.", "Hi.", "What?", "No end", "", " \n", "Gut! ", "日本。", "ok. ", "two\nlines.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"]
    out = []
    for conv in [None, *range(120), 2**60 + 1]:
        for at in range(rng.choice([1, 1, 2, 3, 5, 8, 20])):
            turn = rng.choice([at, at, at, at + 1, at * 2, None])
            role = ("user", "assistant")[at % 2] if rng.random() < 0.7 else rng.choice(roles)
            out.append((conv, turn, role, f"Turn {at} of many." if rng.random() < 0.6 else rng.choice(texts)))
    return [*out, *out[:9]]


def test_every_conversation_equals_the_search(spark, rows):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", "text AS audit", "turn AS at", "role AS conv")
    want = brute(rows)
    got = result(repair.repair_damaged(df))
    assert got == want
    assert sum(v[5] > 0 for v in want.values()) > 30


def test_long_conversations_in_many_segments(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "x"], ["One.", "Two", "", "Three!", "Four?"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"Text {t}.") for c in (1, 2) for t in range(150)]
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = brute(rows)
    for most_rows, rounds in [(1, 0), (7, 3), (4_096, 8)]:
        assert result(repair.repair(df, most_rows=most_rows, rounds=rounds)) == want
    assert result(repair.repair(df, most_chars=40)) == want


def test_rules_are_reversible_and_matrices_agree():
    rng = random.Random(10)
    rules = [(0, 2), (2, 4), (9, 10), (4, 4), (11, 11)]
    known = repair.rule_matrices(rules)
    for _ in range(200):
        symbols = bytes(rng.randrange(repair.BASE_SYMBOLS) for _ in range(rng.randint(0, 30)))
        short = repair.compress(symbols, rules)
        spelled = short
        for number in range(len(rules) - 1, -1, -1):
            spelled = spelled.replace(bytes([repair.BASE_SYMBOLS + number]), bytes(rules[number]))
        assert spelled == symbols
        plain = lambda m: [[e and (e[0], repair.flat(e[1])) for e in line] for line in m]
        assert plain(repair.product(short, known)) == plain(repair.product(symbols, known))


def test_empty_table(spark):
    assert repair.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
