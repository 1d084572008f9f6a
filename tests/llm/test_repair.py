"""Conversation repair: block tables against a plain search over all edits, and whole tables against it too."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def search(turns):
    """Cheapest edits, least in ASCII, of (role, text, must go, truncated) turns: a shortest path over (turn, state, edits)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, q, lines = heapq.heappop(todo)
        if i == len(turns) and q in ("", "a"):
            return cost, audit, lines
        if (i, q) in done:
            continue
        done.add((i, q))
        for x, name in (("u", "user"), ("a", "assistant")):
            if (q, x) in step:
                heapq.heappush(todo, (cost + 2, audit + "I", i, step[q, x], (*lines, f"{name}:")))
        if i < len(turns):
            role, text, bad, cut = turns[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, q, lines))
            if not bad:
                if (q, role[:1]) in step:
                    heapq.heappush(todo, (cost + cut, audit + "K", i + 1, step[q, role[:1]], (*lines, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (q, x) in step:
                        heapq.heappush(todo, (cost + 2 + cut, audit + "R", i + 1, step[q, x], (*lines, f"{name}:{text}")))


def judge(rows):
    """All columns but gaps of one conversation's (turn, role, text) rows in order."""
    faults, seen, turns = [0, 0, 0], set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        bad, cut = True, False
        if not words:
            faults[0] += 1
        elif (role, text) in seen:
            faults[1] += 1
        else:
            bad, cut = False, words[-1] not in ".!?"
            faults[2] += cut
        seen.add((role, text))
        turns.append((role, text, bad, cut))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = search(turns)
    return (*faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        c, t, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows):
    left, out = hurt(rows), {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in left if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *judge(own))
    return out


def test_block_tables_against_a_search():
    r, t = random.Random(5), repair.tables()
    assert len(t.vectors) < 100
    for n in [*range(12), *(r.randint(1, 30) for _ in range(300))]:
        turns = [(r.choice(["system", "user", "assistant", "tool", ""]), "x", r.random() < 0.2, r.random() < 0.3) for _ in range(n)]
        symbols = np.array([0 if bad else 1 + 2 * repair.KINDS.get(role[:1], 0) + cut for role, _, bad, cut in turns], np.int64)
        audit = "".join(x[0] for x in t.trace(symbols, 0, repair.START)) + t.ending(int(t.effect(symbols)[1][0, repair.START]))[0]
        assert audit == search(turns)[1]
        a, b = np.array_split(symbols, [r.randint(0, n)])
        left, state = t.effect(b)
        assert t.effect(a)[0][left].tolist() == t.effect(symbols)[0].tolist()
        for m in range(len(t.vectors)):
            assert state[m][t.effect(a)[1][left[m]]].tolist() == t.effect(symbols)[1][m].tolist()


SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies long, t string"


def run(spark, rows):
    out = repair.repair_report(spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in out.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a b"), (1, 3, "assistant", "C."), (1, 3, "assistant", "C."), (1, 3, "assistant", "C."), (1, 9, "assistant", "C."), (2, 1, "system", " \t\n"), (2, 2, "", "é!"), (3, 5, "tool", "x" * 200_000), (4, None, None, "q?")]
    rows += [(10 + k, t, r, "Yes.") for k in range(30) for t, r in enumerate(["user", "user", "assistant", "system", "user"])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def random_rows(seed, convs, turns):
    r = random.Random(seed)
    return [(c, r.choice([t, t, t, t + 1, None]), r.choice(["system", "user", "assistant", "assistant", "user", "tool", None]), r.choice(["", " ", "One.", "two", f"Three {r.random()}!", "four?\n", None])) for c in range(convs) for t in range(r.randint(1, turns))]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 120, 12)
    assert run(spark, rows) == brute(rows)


def test_one_conversation_over_many_tasks_and_pieces(spark):
    rows = random_rows(3, 1, 4000) + random_rows(4, 3, 5)[:4]
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, role or " ", " " if x is None else x) for c, t, role, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        want[str(conv)] = judge(own)
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)
    parts = repair.repair_conversations(df, piece_turns=7)
    assert parts.where("not whole").select("worker").distinct().count() > 1
    assert {r.conv: tuple(r)[1:] for r in repair.digest_repairs(parts).collect()} == want
    for r in parts.where("whole").collect():
        assert GOOD.fullmatch("".join(x[:1] for x in r.roles))
