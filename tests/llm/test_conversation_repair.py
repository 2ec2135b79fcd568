import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tabwright.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Dijkstra over (cost, edits): the first accepting path is the cheapest, ASCII-least one; rows are (initial, fault)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[q]))
        if i < len(rows):
            ini, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if fault != "x":
                more = 3 * (fault == "t")
                if ini == NEXT[q] or ini == "s" and q == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, ini))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[q]))


def plain(rows):
    """The whole contract for one conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    short = [((r[:1] if r[:1] in ("s", "u", "a") else "-"), {"": ".", "truncated": "t"}.get(f, "x")) for (_, r, _), f in zip(rows, faults)]
    cost, audit = cheapest(short)
    out, at, q = [], iter(rows), ""
    for e in audit:
        _, role, text = (None, "", "") if e == "I" else next(at)
        if e != "D":
            role = role if e == "K" else {"u": "user", "a": "assistant"}[NEXT[q]]
            q = role[0]
            out.append(f"{role}:{text}")
    return ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        fill = lambda v: " " if v is None else str(v)
        role, text, how = fill(role), fill(text), zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        kept = out.setdefault(conv, [])
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
        kept.extend([(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1))
    return out


def test_search_is_the_cheapest_and_least():
    kinds = [a + b for a in "sua-" for b in ".tx"]
    rnd = random.Random(7)
    for n in range(4):
        for rows in itertools.islice(itertools.product(kinds, repeat=n), 0, None, 1 if n < 3 else 7):
            assert C.search(rows, "", C.ACCEPT)[:2] == cheapest(rows), rows
    for _ in range(150):
        rows = tuple(rnd.choice(kinds) for _ in range(rnd.randint(4, 12)))
        assert C.search(rows, "", C.ACCEPT)[:2] == cheapest(rows), rows


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_runs_join_to_the_same_answer(monkeypatch, run):
    monkeypatch.setattr(C, "RUN", run)
    rnd = random.Random(run)
    for _ in range(300):
        rows = sorted([(rnd.randint(0, 9), rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["a.", "b", " ", "c!", "", "d ?"]))
                       for _ in range(rnd.randint(0, 14))])
        conv, seen = C._Conversation(1), set()
        for t, r, x in rows:
            conv.add(t, r, x, (r, x) in seen)
            seen.add((r, x))
        assert conv.result()[1:] == plain(rows), rows


def test_long_conversation_in_runs():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["user", "assistant"]), f"text {i}" + rnd.choice([".", "."])) for i in range(5000)]
    conv = C._Conversation(1)
    for t, r, x in rows:
        conv.add(t, r, x, False)
    assert conv.result()[1:] == plain(rows)


def test_whole_query_on_random_tables(spark):
    rnd = random.Random(5)
    pick = lambda *v: rnd.choice(v)
    rows = [(rnd.choice([None, *range(60)]), pick(None, *range(8)), pick("user", "assistant", "system", None, "tool", ""),
             pick("One.", "two", "\n", "", None, "Drei?", "é!", "x" * 50_000)) for _ in range(700)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("c", "t", "r", "x", "p", "seen", "how", "gone", "copy")})
    got = {r.conv_id: tuple(r)[1:] for r in C.damage_and_repair(df).collect()}
    want = {c: plain(r) for c, r in damaged(rows).items()}
    assert got == want


def test_none_left_and_no_rows(spark):
    conv = next(k for k in itertools.count() if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = C.damage_and_repair(spark.createDataFrame([(conv, 0, "user", "a.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []
