"""Conversation repair: the program against a search over all edit lists, the query against a plain version."""
import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import types as T

from navlens.llm import conversations as C, damage, queries
from navlens.llm.common import table

rnd = random.Random(3)
CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                              T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPACE = " \t\n\x0b\x0c\r"


def allowed(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def faults(rows):
    """rows (turn, role, text) -> fault of each: blank, duplicate, truncated or None."""
    seen, out = set(), []
    for _, role, text in rows:
        t = text.rstrip(SPACE)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, messages) by a uniform-cost search that takes equal costs in ASCII order of the edits."""
    fs = faults(rows)
    queue, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, roles = heapq.heappop(queue)
        state = (i, roles if len(roles) < 2 else roles[0] + roles[-1])
        if i == len(rows) and allowed(roles):
            break
        if state in done:
            continue
        done.add(state)

        def push(more, letter, j, role):
            new = roles + role
            if role == "" or any(allowed(new + x) for x in ("", "a", "ua")):
                heapq.heappush(queue, (cost + more, audit + letter, j, new))
        for role in "ua":
            push(3, "I", i, role)
        if i < len(rows):
            push(4, "D", i + 1, "")
            if fs[i] not in ("blank", "duplicate"):
                more = 3 if fs[i] else 0
                if rows[i][1][:1] in ("s", "u", "a"):
                    push(more, "K", i + 1, rows[i][1][:1])
                for role in "ua":
                    push(3 + more, "R", i + 1, role)
    out, left, names = [], iter(rows), {"u": "user", "a": "assistant"}
    for letter in audit:
        row = ("", "", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        role = row[1] if letter == "K" else names["a" if out and out[-1][0][0] == "u" else "u"]
        out.append((role, row[2]))
    return cost, audit, out


def plain_row(rows):
    turns = [t for t, _, _ in rows if t is not None]
    fs = faults(rows)
    cost, audit, out = plain_repair(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fs.count("blank"), fs.count("duplicate"),
            fs.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def random_rows(n):
    turn, rows = rnd.choice([None, 0, 5]), []
    for _ in range(n):
        rows.append((turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
                     rnd.choice(["Yes.", "No!", "well", "", " \n", f"t{rnd.randint(0, 99)}.", "x?  "])))
        turn = turn if rnd.random() < .1 else (turn or 0) + rnd.choice([1, 1, 1, 2])
    return sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2]))


def test_program_against_search():
    for _ in range(3000):
        rows = random_rows(rnd.randint(0, 7))
        fs = faults(rows)
        codes = bytes(C.code_of(r[1][:1], C.MUST_GO if f in ("blank", "duplicate") else C.CUT_OFF if f else C.FINE)
                      for r, f in zip(rows, fs))
        walk = C.Walk(codes, C.AT_END)
        (audit,), (state,) = walk.edits([C.START])
        cost, want, _ = plain_repair(rows)
        assert (walk.cost + walk.start[C.START], audit + C.closing(state)) == (cost, want), rows


def test_search_against_all_edit_lists():
    """The search itself: every list of up to 6 edits."""
    for _ in range(40):
        rows = random_rows(rnd.randint(0, 2))
        fs, best = faults(rows), None
        for n in range(7):
            for letters in itertools.product("DIKR", repeat=n):
                if sum(x != "I" for x in letters) != len(rows):
                    continue
                cost, roles, i = 0, "", 0
                for x in letters:
                    if x == "I":
                        cost, roles = cost + 3, roles + ("a" if roles[-1:] == "u" else "u")
                        continue
                    must, cut = fs[i] in ("blank", "duplicate"), 3 if fs[i] == "truncated" else 0
                    if x != "D" and must:
                        cost = 10 ** 6
                    cost += {"D": 4, "K": cut, "R": 3 + cut}[x]
                    roles += {"D": "", "K": rows[i][1][:1] or "?", "R": "a" if roles[-1:] == "u" else "u"}[x]
                    i += 1
                if allowed(roles) and cost < 10 ** 6:
                    best = min(best or (cost, "".join(letters)), (cost, "".join(letters)))
        assert plain_repair(rows)[:2] == best, rows


@pytest.mark.parametrize("pieces", [1, 3, 4096])
def test_conversations_in_pieces(spark, pieces):
    groups = {conv: random_rows(rnd.randint(1, 14)) for conv in range(40)} | {None: random_rows(9), 99: random_rows(60)}
    rows = [(conv, *r) for conv, rs in groups.items() for r in rs]
    rnd.shuffle(rows)
    got, messages = C.repair_conversations(spark.createDataFrame(rows, CONVERSATIONS), True, piece_rows=pieces)
    got = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert got == {conv: plain_row(rs) for conv, rs in groups.items()}
    left = sorted(((m.conv_id, m.part, m.piece, m.messages) for m in messages.collect()), key=lambda m: (str(m[0]), m[1:3]))
    for conv, rs in groups.items():
        assert [tuple(x) for m in left if m[0] == conv for x in m[3]] == plain_repair(rs)[2]


def damaged(rows):
    out = {}
    for r in rows:
        conv, turn, role, text = (" " if x is None else x for x in r)
        f = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        out.setdefault(r[0], []).extend([(r[1], "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1))
    return {k: sorted(v, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2])) for k, v in out.items()}


def test_query_against_plain_version(spark, sf, tmp_path):
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = [(10 ** 6, None, None, None), (10 ** 6, 0, "user", "Hi."), (10 ** 6, 0, "user", "Hi."), (None, 1, "user", "A."),
            (None, None, "assistant", "B" * 50_000)] + [(10 ** 6 + k, 0, "user", "x.") for k in range(1, 60)]
    given.unionByName(spark.createDataFrame(more, CONVERSATIONS)).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = {conv: plain_row(rs) for conv, rs in damaged(rows).items()}
    assert got == want
    assert any(not rs for rs in damaged(rows).values())


def test_empty_table(spark):
    got, messages = C.repair_conversations(damage.with_faults(spark.createDataFrame([], CONVERSATIONS)), True)
    assert got.collect() == [] and messages.collect() == []
