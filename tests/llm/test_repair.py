"""Conversation repair: every edit script by brute force, long conversations in pieces, odd rows, and the SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from reportloom.llm import repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        role, text = said(role), said(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def accepted(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows, faults):
    """Cheapest edits by a best-first search over (cost, audit) whose states are the whole strings of initials, shortened to what the pattern can tell."""
    short = lambda s: re.sub("(ua)+$", "ua", re.sub("^(s?)(ua)+(?=u?$)", r"\1ua", s))
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, roles = heapq.heappop(heap)
        if k == len(rows) and accepted(roles):
            return cost, audit
        if (k, roles) in seen:
            continue
        seen.add((k, roles))
        moves = [("I", 5, x) for x in "ua"]
        if k < len(rows):
            more = 5 if faults[k] == "truncated" else 0
            moves.append(("D", 2, ""))
            if faults[k] not in ("blank", "duplicate"):
                moves += [("K", more, rows[k][1][:1] or "?"), *(("R", 1 + more, x) for x in "ua")]
        for edit, paid, initial in moves:
            new = short(roles + initial)
            if len(new) <= 4 and re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + paid, audit + edit, k + (edit != "I"), new))
    raise AssertionError


def brute(rows):
    out = []
    for conv, own in hurt(rows).items():
        faults, seen = [], set()
        for turn, role, text in own:
            bare = text.strip(" \t\n\r\x0b\x0c")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(own, faults)
        lines, k, state = [], 0, ""
        for e in audit:
            if e == "I":
                state = "assistant" if state[:1] == "u" else "user"
                lines.append(f"{state}:")
                continue
            turn, role, text = own[k]
            k += 1
            if e == "D":
                continue
            state = role if e == "K" else "assistant" if state[:1] == "u" else "user"
            lines.append(f"{state}:{text}")
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, repair.repair(repair.damaged(df)).collect()), key=str)


def test_query_and_sql_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, repair.op13_repair(spark, SF).collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(con.execute(repair.OP13_SQL).fetchall(), key=str) == want


def random_rows(rng, convs, most):
    texts = ["Yes.", "No", "  ", "", None, "a b!", "what? \n", "Yes.", "é.", "x" * 300]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "upper"]
    rows = []
    for c in range(convs):
        for _ in range(rng.randint(1, most)):
            t = rng.choice([None, *range(most)])
            row = (c or None, t, rng.choice(roles), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


def test_odd_rows_equal_brute_force(spark):
    rows = random_rows(random.Random(13), 120, 9)
    assert result(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n int")) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("long", [0, 6])
def test_long_conversations_in_pieces(spark, monkeypatch, long):
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "PIECE", 3)
    rows = random_rows(random.Random(14 + long), 40, 14)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_conversation_without_rows_after_damage(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert result(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_hot_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k % 700}.") for k in range(3000)] + [(k, 0, "user", "Hi.") for k in range(2, 30)]
    got = {r[0]: r for r in result(spark.createDataFrame(rows, SCHEMA))}
    assert len(got) == 29
    own = hurt(rows)[1]
    faults, seen = [], set()
    for _, role, text in own:
        bare = text.strip()
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    assert got[1][2:5] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated")) and got[1][6:8] == cheapest(own, faults)
