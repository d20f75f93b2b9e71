"""Conversation repair against a plain shortest path and against its SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from bicspark.llm import blocktables, conversations
from bicspark.llm.common import ship_code
from bicspark.llm.oracles import CONVERSATIONS

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROWS = [
    (1, 0, "user", "a."), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", " \n"), (1, 5, "user", "c!"),
    (2, None, "system", "s."), (2, None, None, None), (2, 3, "", "x."), (2, 3, "tool", "y?  \t"), (2, 3, "user", "z."),
    (None, 1, "assistant", "q."), (None, 1, "user", "q."), (None, None, "user", "q."), (None, None, "user", "q."),
    (2**60 + 1, 7, "assistant", "\x85."), (4, 0, "user", "long " * 50_000), (4, 2**62, "assistant", "end."),
]


def plain(rows, damage):
    """Every conversation by itself, all edits by dynamic programming over (cost, letters)."""
    known = {}
    for conv, turn, role, text in rows:
        got = known.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20 if damage else 19
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        got += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return {conv: _plain(got) for conv, got in known.items()}


def _plain(got):
    got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    kinds, seen = [], set()
    for _, role, text in got:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("b" if not bare else "d" if (role, text) in seen else "f" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    never = (10**9, "")

    def inserting(v):
        for _ in range(4):
            v = [min(v[q], (v[NEXT[q]][0] + 2, "I" + v[NEXT[q]][1])) for q in range(4)]
        return v

    v = inserting([(0, ""), never, never, (0, "")])
    for kind, (_, role, _) in reversed(list(zip(kinds, got))):
        after, v = v, []
        for q in range(4):
            options = [(after[q][0] + 3, "D" + after[q][1])]
            if kind in "ft":
                cut = int(kind == "t")
                if (q, role[:1]) in KEPT:
                    to = after[KEPT[q, role[:1]]]
                    options.append((to[0] + cut, "K" + to[1]))
                options.append((after[NEXT[q]][0] + 2 + cut, "R" + after[NEXT[q]][1]))
            v.append(min(options))
        v = inserting(v)
    cost, audit = v[0]
    state, rest, lines = 0, iter(got), []
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rest)[1:]
        if letter != "D":
            state = KEPT[state, role[:1]] if letter == "K" else NEXT[state]
            lines.append((letter, role if letter == "K" else {2: "user", 3: "assistant"}[state], text))
    turns = [t for t, _, _ in got if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, audit, digest), lines


def test_blocks_find_the_least_edits():
    """All strings of up to three symbols, and random ones cut into two fragments."""
    rows = [(0, 0, "?", " ")] + [(0, 0, r, t) for t in (".", "x") for r in ("s", "u", "a", "o")]

    def expected(symbols):
        got = [(k, rows[int(s)][2], f"{k}{rows[int(s)][3]}" if s != "0" else "") for k, s in enumerate(symbols)]
        return _plain(got)[0][5:7]

    for symbols in itertools.chain.from_iterable(itertools.product("012345678", repeat=n) for n in range(4)):
        audit, _, cost = blocktables.trace("".join(symbols))
        assert (cost, audit) == expected(symbols)
    draw = random.Random(5)
    for _ in range(300):
        symbols = "".join(draw.choices("012345678", k=draw.randint(4, 30)))
        cut = draw.randint(0, len(symbols))
        after = int(blocktables.transition(symbols[cut:])[0][0])
        left, state, cost = blocktables.trace(symbols[:cut], after=after, ends=False)
        right, _, more = blocktables.trace(symbols[cut:], state)
        assert (cost + more, left + right) == expected(symbols)


@pytest.mark.parametrize("damage", [False, True])
def test_audit_and_lines(spark, damage):
    ship_code(spark)
    table = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("times", "row_", "digest", "letters", "edits", "after", "conv_id_")})
    rows = conversations.damaged(table) if damage else conversations.rows_of(table)
    expected = plain(ROWS, damage)
    found = conversations.audit(rows).collect()
    assert len(found) == len(expected) and {r["conv_id"]: tuple(r)[1:] for r in found} == {c: e for c, (e, _) in expected.items()}
    lines = {}
    for r in conversations.repaired(rows).orderBy("place").collect():
        lines.setdefault(r["conv_id"], []).append(tuple(r)[2:])
    assert lines == {c: e for c, (_, e) in expected.items() if e}
    assert conversations.audit(rows.where("false")).count() == 0


def test_conversations_over_many_partitions(spark):
    """Two conversations hold all rows, one of them mostly copies of one row and of one text."""
    draw = random.Random(3)
    rows = [(k % 2, k // 3, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["a.", "b", "", f"{k}."])) for k in range(600)]
    rows += [(1, 50, "user", "copy.")] * 300 + [(1, k, "user", "same.") for k in range(300)]
    ship_code(spark)
    keys = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = conversations.audit(conversations.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == {c: e for c, (e, _) in plain(rows, True).items()}


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert {r[0]: r[1:] for r in con.sql(CONVERSATIONS).fetchall()} == {c: e for c, (e, _) in plain(rows, True).items()}
