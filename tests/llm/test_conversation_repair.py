"""Conversation repair against every possible edit of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kelvinlake.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def edits(rows, inserts):
    """Every (cost, audit, lines) of rows (role, text, fault)."""
    out = []
    if inserts:
        for cost, audit, lines in edits(rows, inserts - 1):
            out += [(cost + 5, "I" + audit, [(r, "")] + lines) for r in ("user", "assistant")]
    if not rows:
        return out + [(0, "", [])]
    (role, text, fault), rest = rows[0], rows[1:]
    more = 5 if fault == "truncated" else 0
    for cost, audit, lines in edits(rest, inserts):
        out.append((cost + 2, "D" + audit, lines))
        if fault in ("", "truncated"):
            out.append((cost + more, "K" + audit, [(role, text)] + lines))
            out += [(cost + 1 + more, "R" + audit, [(r, text)] + lines) for r in ("user", "assistant")]
    return out


def fault_of(role, text, seen):
    core = text.strip(BLANKS)
    if not core:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "" if core[-1] in ".!?" else "truncated"


def brute(conversation, inserts=2):
    """conversation: (turn, role, text) of one conv_id -> the row of the query, without the id."""
    rows, key = [], conversation[0][0]
    for conv, turn, role, text in conversation:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    for _, role, text in rows:
        marked.append((role, text, fault_of(role, text, seen)))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    ok = [(c, a, lines) for c, a, lines in edits(marked, inserts) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines))]
    cost, audit, lines = min(ok, key=lambda x: x[:2])
    count = [f for _, _, f in marked]
    bad = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (key, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count.count("blank"), count.count("duplicate"), count.count("truncated"), bad, cost, audit, sha)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def expected(rows):
    ordered = by_key(rows)
    return [brute(list(g)) for _, g in itertools.groupby(ordered, key=lambda r: r[0])]


def made_up(n, seed):
    rnd = random.Random(seed)
    texts = ["Hi there.", "Fine!", "cut off", "", "  \n", "Why? ", "end.\t", "\u0085", None]
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    weights = [2, 8, 8, 1, 0.5, 0.5, 0.5]
    out = []
    for conv in range(n):
        conv_id = conv * 7 + 1 if conv else None
        for turn in range(rnd.randint(1, 5)):
            out.append((conv_id, rnd.choice([turn, turn, turn, turn + 3, None]), rnd.choices(roles, weights)[0], rnd.choice(texts)))
    return out


def test_small_conversations_by_all_edits(spark):
    rows = made_up(60, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = by_key(tuple(r) for r in cr.repair(cr.damaged(df)).select(*COLUMNS).collect())
    assert got == expected(rows)


def test_blocks_join_to_the_same_result(spark, monkeypatch):
    """Every block of one row, so all conversations are put together from blocks."""
    rows = made_up(25, 5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    symbols = [("s", ""), ("u", ""), ("u", "truncated"), ("a", "blank"), ("a", ""), ("t", ""), ("u", "duplicate"), ("a", "truncated")]
    rnd = random.Random(1)
    for n in range(1, 60):
        seq = [rnd.choice(symbols) for _ in range(n)]
        whole = min(v for s, v in ((b, (c, a)) for e, b, c, a in cr.transfers(seq, ("none",))) if s in cr.ACCEPTING)
        joined, at = cr.Joined(), 0
        while at < n:
            step = rnd.randint(1, 9)
            joined.add(cr.transfers(seq[at : at + step]))
            at += step
        assert joined.result() == whole
    got = by_key(tuple(r) for r in cr.repair(cr.damaged(df.repartition(1))).select(*COLUMNS).collect())
    assert got == expected(rows)


def test_long_conversation_over_many_tasks(spark):
    """One conversation that is cut into blocks and spread over tasks equals its parse in one piece."""
    rnd = random.Random(7)
    rows = [(5, t, rnd.choice(["user", "assistant"]), f"row {t % 700} {'.' if t % 3 else ''}") for t in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = cr.repair(cr.damaged(df)).first()
    kept, seen = [], set()
    for _, turn, role, text in rows:
        kind = zlib.crc32(f"5:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            kept.append((role, text, fault_of(role, text, seen)))
            seen.add((role, text))
    # the least cost by a table over states, and the audit must cost as much
    inf = 10**9
    best = {"": 0}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(b):
        for _ in range(3):
            for s, c in list(b.items()):
                b[step[s]] = min(b.get(step[s], inf), c + 5)
        return b

    best = closed(best)
    for role, _, fault in kept:
        new = {s: c + 2 for s, c in best.items()}
        if fault in ("", "truncated"):
            extra = 5 if fault else 0
            for s, c in best.items():
                if s == "" and role[0] == "s":
                    new["s"] = min(new.get("s", inf), c + extra)
                t = step[s]
                new[t] = min(new.get(t, inf), c + extra + (role[0] != t))
        best = closed(new)
    assert r["cost"] == min(best.get("", inf), best.get("a", inf))
    assert r["audit"].count("D") + r["audit"].count("K") + r["audit"].count("R") == len(kept)
    assert r["repaired_sha256"] == cr.digest(r["audit"], [(a, b) for a, b, _ in kept])
    assert r["blank"] == sum(f == "blank" for _, _, f in kept) and r["duplicate"] == sum(f == "duplicate" for _, _, f in kept)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, copies int, kind string"
    assert cr.repair(cr.damaged(spark.createDataFrame([], schema))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cr.repair(cr.damaged(spark.createDataFrame([(gone, 0, "user", "x", 3, "row")], schema))).first()
    assert tuple(got)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Oh."), (1, 2, "assistant", "Well.")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in cr.repaired_rows(df).orderBy("at").collect()]
    assert [g[2] for g in got] == ["user", "assistant"]


def test_query_against_all_edits(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in t.collect()]
    sizes = {k: len(list(g)) for k, g in itertools.groupby(by_key(rows), key=lambda r: r[0])}
    small = [r for r in rows if sizes[r[0]] <= 5]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.op11_conversation_repair(spark, SF).collect()}
    assert set(got) == set(sizes)
    want = expected(small)
    assert [got[w[0]] for w in want] == want
    assert want
