r"""Repair of damaged conversations by error-correcting Earley parsing.

A weighted grammar of roles, `(s?(ua)+)?`, has productions for each edit of a row: keep, rerole and delete consume it,
insert consumes none. The grammar is left recursive, so items of the chart begin in its first column or in the last but
one, and the parser holds those columns alone. Every item retains the least (cost, audit) of its derivations; the audit
names the edits in order by K, R, D and I. Comparing audits item by item is sound: two audits over the same rows of which
one begins the other differ in cost (by the inserts more), so what follows never turns their order. The roles of the
repaired rows follow from the audit: with an odd number of rows left, the first is the system's, and users and
assistants alternate.

Conversations are dealt to tasks by ranges of (conversation, turn, role, text) after equal rows are counted, so one of any
size is spread over tasks. A task parses conversations that lie within one block of it at once; of others (those cut by
the bounds of tasks, or longer than a block) it gives the best audits of each block between any two states of the grammar.
Blocks are then put together in order, and the audit is played over the rows again. Only this last digest, a chain over
the whole text, reads a conversation in one task, a row at a time.

Defined cases: a null conv_id is a conversation of its own; a null role or text, or a null id in the damage key, counts as
one space; null turns come first; rows of one turn are ordered by role, then text; repeated rows are duplicates; a role
that is neither s.., u.. nor a.. must be reroled or deleted; a conversation without rows left has zeros, an empty audit and the
digest of the empty string; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import NO_ID, cut, join_keys, table

BLANK = r"^[\x20\x09-\x0D]*\z"
UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A block ends after so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000
#: States of the grammar: nothing yet, after the system's row, after a user's, after an assistant's.
STATES = ("none", "system", "user", "pairs")
ACCEPTING = ("none", "pairs")

# --- the grammar and its parser -----------------------------------------------------------------------------------

#: (left side, right side, cost, edit). What starts with a capital is an edit of a row; `=s` and the like consume a row.
EDITS = (
    ("Delete", ("=any",), DELETE, "D"),
    ("System", ("=s",), KEEP, "K"),
    ("User", ("=u",), KEEP, "K"),
    ("User", ("=sound",), REROLE, "R"),
    ("User", (), INSERT, "I"),
    ("Assistant", ("=a",), KEEP, "K"),
    ("Assistant", ("=sound",), REROLE, "R"),
    ("Assistant", (), INSERT, "I"),
)
MOVES = (
    ("system", ("none", "System"), 0, ""),
    ("user", ("none", "User"), 0, ""),
    ("user", ("system", "User"), 0, ""),
    ("user", ("pairs", "User"), 0, ""),
    ("pairs", ("user", "Assistant"), 0, ""),
    *((state, (state, "Delete"), 0, "") for state in STATES),
)


class Grammar:
    def __init__(self, entry: str):
        """The grammar of what can follow `entry`."""
        self.rules = ((entry, (), 0, ""), *MOVES, *EDITS)
        self.of = {left: [i for i, r in enumerate(self.rules) if r[0] == left] for left in (*STATES, "Delete", "System", "User", "Assistant")}


@functools.cache
def grammar(entry: str) -> Grammar:
    return Grammar(entry)


class Chart:
    """Earley's chart over rows (initial, fault); an item is (rule, dot, whether it begins in the first column)."""

    def __init__(self, entry: str = "none"):
        self.grammar = grammar(entry)
        self.column: dict[tuple, tuple[int, str]] = {}
        for state in STATES:
            for rule in self.grammar.of[state]:
                self.column[rule, 0, True] = (0, "")
        self._close()

    def add(self, initial: str, fault: str) -> None:
        """Scans a row."""
        extra = TRUNCATED if fault == "truncated" else 0
        sound = fault in ("", "truncated")
        after: dict[tuple, tuple[int, str]] = {}
        rules = self.grammar.rules
        for (rule, dot, old), (cost, audit) in self.column.items():
            _, right, edit_cost, edit = rules[rule]
            if dot == len(right) or right[dot][0] != "=":
                continue
            if right[dot] == "=any":
                price = 0
            elif sound and (right[dot] == "=sound" or right[dot] == "=" + initial):
                price = extra
            else:
                continue
            after[rule, dot + 1, False] = (cost + edit_cost + price, audit + edit)
        self._scanned(after)

    def _scanned(self, done: dict) -> None:
        before, self.column = self.column, {}
        rules = self.grammar.rules
        for (rule, _, _), (cost, audit) in done.items():  # complete edits of one row: they advance items of the column before
            for (outer, dot, old), (c, a) in before.items():
                right = rules[outer][1]
                if dot < len(right) and right[dot] == rules[rule][0]:
                    self._keep((outer, dot + 1, old), (c + cost, a + audit))
        self._close()

    def _keep(self, item: tuple, value: tuple[int, str]) -> bool:
        if item in self.column and self.column[item] <= value:
            return False
        self.column[item] = value
        return True

    def _close(self) -> None:
        """Predicts and completes until no item gets better."""
        rules, of = self.grammar.rules, self.grammar.of
        agenda = list(self.column)
        while agenda:
            item = agenda.pop()
            rule, dot, old = item
            left, right, edit_cost, edit = rules[rule]
            cost, audit = self.column[item]
            if dot < len(right):
                wanted = right[dot]
                if wanted[0] == "=":
                    continue
                for r in of[wanted] if wanted[0].isupper() else ():
                    if rules[r][1]:
                        if self._keep((r, 0, False), (0, "")):
                            agenda.append((r, 0, False))
                    elif self._keep((rule, dot + 1, old), (cost + rules[r][2], audit + rules[r][3])):
                        agenda.append((rule, dot + 1, old))  # an insert is complete where it begins
            elif old:
                for outer in range(len(rules)):  # a state that begins in the first column advances what waits for it there
                    if rules[outer][1][:1] == (left,) and self._keep((outer, 1, True), (cost, audit)):
                        agenda.append((outer, 1, True))

    def best(self) -> dict[str, tuple[int, str]]:
        """state -> the least (cost, audit) of the rows so far that ends in it."""
        out: dict[str, tuple[int, str]] = {}
        for (rule, dot, old), value in self.column.items():
            left, right, _, _ = self.grammar.rules[rule]
            if old and dot == len(right) and (left not in out or value < out[left]):
                out[left] = value
        return out


def transfers(rows: Iterable[tuple[str, str]], entries: tuple[str, ...] = STATES) -> list[tuple[str, str, int, str]]:
    """(state before, state behind, cost, audit) of the best edits of rows (initial, fault)."""
    rows = list(rows)
    out = []
    for entry in entries:
        chart = Chart(entry)
        for initial, fault in rows:
            chart.add(initial, fault)
        out += [(entry, state, cost, audit) for state, (cost, audit) in chart.best().items()]
    return out


class Joined:
    """The best audits up to now, put together from blocks; what all of them begin with is settled."""

    def __init__(self):
        self.settled: list[str] = []
        self.paths: dict[str, tuple[int, str]] = {"none": (0, "")}

    def add(self, moves: Iterable[tuple[str, str, int, str]]) -> None:
        after: dict[str, tuple[int, str]] = {}
        for before, behind, cost, audit in moves:
            if before in self.paths:
                c, a = self.paths[before]
                value = (c + cost, a + audit)
                if behind not in after or value < after[behind]:
                    after[behind] = value
        same = commonprefix([a for _, a in after.values()])
        self.settled.append(same)
        self.paths = {s: (c, a[len(same) :]) for s, (c, a) in after.items()}

    def result(self) -> tuple[int, str]:
        cost, rest = min(self.paths[s] for s in ACCEPTING if s in self.paths)
        return cost, "".join(self.settled) + rest


class Replay:
    """Plays an audit over rows: yields the repaired (role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.shown = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        place = self.shown - self.odd
        self.shown += 1
        return "system" if place < 0 else ("user", "assistant")[place % 2]

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            new = self._role()
            yield role if edit == "K" else new, text


class Digest:
    """SHA-256 of `role:text` lines joined by newlines."""

    def __init__(self):
        self.sha, self.lead = hashlib.sha256(), ""

    def take(self, rows: Iterable[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update(f"{self.lead}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lead = "\n"


# --- rows ---------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the contract's damage, equal rows counted. A dropped row has no copies, and stands
    for its conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    gone = F.col("_kind") == 0
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(gone, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    blanked = lambda c: F.when(gone, "").otherwise(c)
    return out.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), blanked(role).alias("role"), blanked(text).alias("text"), copies.alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) with equal ones counted and `fault`, the first of blank, duplicate and truncated
    that holds for the first copy, or empty. Further copies are duplicates (or blank)."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat_ws("\u0000", F.col("conv_id").isNull().cast("string"), F.coalesce("conv_id", F.lit(0)).cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    place = F.when(F.col("copies") > 0, F.coalesce("turn", F.lit(NO_ID)))
    keyed = counted.withColumns({"said": said, "place": place})
    first = keyed.groupBy("said").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("turns"))
    marked = join_keys(keyed, first, ["said"], "turns", rows.count())
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("place") > F.col("first_place"), "duplicate").when(F.col("text").rlike(UNFINISHED), "truncated").otherwise("")
    return marked.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


# --- tasks --------------------------------------------------------------------------------------------------------

_SUMS = ["n_blank", "n_duplicate", "n_truncated", "n_illegal"]
_MOVE = pa.struct([("before", pa.string()), ("behind", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
#: kind: whole (a finished conversation), block, or row (of a block).
_PARTS = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in _SUMS), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string())]
    + [("moves", pa.list_(_MOVE)), ("first_role", pa.string()), ("last_role", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]
)
_PARTS_SQL = (
    "kind string, conv_id long, part long, at long, gaps long, " + ", ".join(f"{c} long" for c in _SUMS) + ", cost long, audit string, sha string, "
    "moves array<struct<before: string, behind: string, cost: long, audit: string>>, first_role string, last_role string, low long, high long, turns long, role string, text string, copies long"
)


class Block:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.chars = conv_id, [], 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        self.rows.append((turn, role, text, copies, fault))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def symbols(self) -> Iterator[tuple[str, str]]:
        for _, role, _, copies, fault in self.rows:
            for k in range(copies):
                yield role[:1], fault if k == 0 or fault == "blank" else "duplicate"

    def facts(self) -> dict:
        seen = [fault for _, fault in self.symbols()]
        roles = [initial for initial, _ in self.symbols()]
        there = sorted({turn for turn, _, _, copies, _ in self.rows if copies and turn is not None})
        return {
            **{f"n_{k}": seen.count(k) for k in ("blank", "duplicate", "truncated")}, "n_illegal": illegal(roles), "first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None,
            "low": there[0] if there else None, "high": there[-1] if there else None, "turns": len(there),
        }


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def digest(audit: str, rows: Iterable[tuple[str, str]]) -> str:
    out, replay = Digest(), Replay(audit)
    for role, text in rows:
        out.take(replay.row(role, text))
    out.take(replay.inserts())
    return out.sha.hexdigest()


def _parse_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> finished conversations, and blocks with their rows of those that may go on in another task."""
    base, seq = TaskContext.get().partitionId() << 32, 0
    out: list[dict] = []

    def finished(block: Block) -> dict:
        facts = block.facts()
        cost, audit = min(v for s, v in _best(block).items() if s in ACCEPTING)
        sha = digest(audit, ((role, text) for _, role, text, copies, _ in block.rows for _ in range(copies)))
        return {"kind": "whole", "conv_id": block.conv_id, "gaps": gaps(facts["low"], facts["high"], facts["turns"]), **{c: facts[c] for c in _SUMS}, "cost": cost, "audit": audit, "sha": sha}

    def part(block: Block) -> Iterator[dict]:
        nonlocal seq
        moves = [dict(zip(("before", "behind", "cost", "audit"), m)) for m in transfers(block.symbols())]
        yield {"kind": "block", "conv_id": block.conv_id, "part": base + seq, "at": -1, "moves": moves, **block.facts()}
        for at, (_, role, text, copies, _) in enumerate(block.rows):
            if copies:
                yield {"kind": "row", "conv_id": block.conv_id, "part": base + seq, "at": at, "role": role, "text": text, "copies": copies}
        seq += 1

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least and out:
            yield pa.RecordBatch.from_pylist(out, _PARTS)
            out.clear()

    block, whole = None, False
    for batch in batches:
        for conv_id, turn, role, text, copies, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if block is None:
                block = Block(conv_id)
            elif conv_id != block.conv_id:
                out.extend([finished(block)] if whole else part(block))
                block, whole = Block(conv_id), True
            elif block.full():
                out.extend(part(block))
                block, whole = Block(conv_id), False
            block.add(turn, role, text, copies, fault)
            yield from flushed(2000)
    if block is not None:
        out.extend(part(block))
    yield from flushed(1)


def _best(block: Block) -> dict[str, tuple[int, str]]:
    chart = Chart()
    for initial, fault in block.symbols():
        chart.add(initial, fault)
    return chart.best()


def _join_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order -> the conversation's counts, cost and audit (kind `header`)."""
    now: dict | None = None

    def shown() -> pa.RecordBatch:
        cost, audit = joined.result()
        row = {"kind": "header", "conv_id": now["conv_id"], "part": -1, "at": -1, "gaps": gaps(now["low"], now["high"], now["turns"]), **{c: now[c] for c in _SUMS}, "cost": cost, "audit": audit}
        return pa.RecordBatch.from_pylist([row], _PARTS)

    for batch in batches:
        for b in batch.to_pylist():
            if now is None or b["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield shown()
                now, joined = {**b, **dict.fromkeys(_SUMS, 0), "low": None, "high": None, "turns": 0, "last_role": None}, Joined()
            joined.add((m["before"], m["behind"], m["cost"], m["audit"]) for m in b["moves"])
            for c in _SUMS:
                now[c] += b[c]
            if b["first_role"] is not None:
                now["n_illegal"] += now["last_role"] is not None and illegal([now["last_role"], b["first_role"]])
                now["last_role"] = b["last_role"]
            if b["low"] is not None:
                now["turns"] += b["turns"] - (now["high"] == b["low"])
                now["low"], now["high"] = b["low"] if now["low"] is None else now["low"], b["high"]
    if now is not None:
        yield shown()


def _replay_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its header, then its rows -> finished conversations."""
    head, replay, out = None, None, None

    def shown() -> pa.RecordBatch:
        out.take(replay.inserts())
        return pa.RecordBatch.from_pylist([{**head, "kind": "whole", "sha": out.sha.hexdigest()}], _PARTS)

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == "header":
                if head is not None:
                    yield shown()
                head, replay, out = r, Replay(r["audit"]), Digest()
            else:
                for _ in range(r["copies"]):
                    out.take(replay.row(r["role"], r["text"]))
    if head is not None:
        yield shown()


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies; see damaged()) -> a row for each conversation: counts of its faults, gaps and illegal
    neighbours, the least cost of a repair, its audit, and the digest of the repaired `role:text` lines."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = cut(dealt.mapInArrow(_parse_task, _PARTS_SQL), "conversation-parts")
    by = lambda t: t.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "at")
    heads = by(parts.filter("kind = 'block'")).mapInArrow(_join_task, _PARTS_SQL)
    rest = by(heads.unionByName(parts.filter("kind = 'row'"))).mapInArrow(_replay_task, _PARTS_SQL)
    done = parts.filter("kind = 'whole'").unionByName(rest)
    count = {"blank": "n_blank", "duplicate": "n_duplicate", "truncated": "n_truncated", "illegal": "n_illegal"}
    return done.select("conv_id", "gaps", *(F.col(c).alias(k) for k, c in count.items()), "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) of small conversations, undamaged by us -> (conv_id, at, role, text) as repaired: the
    operator for use, where a conversation's rows fit a task."""
    copies = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))

    def run(batch: pa.Table) -> pa.Table:
        block = Block(batch.column("conv_id")[0].as_py())
        ordered = sorted(batch.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
        for r in ordered:
            block.add(r["turn"], r["role"], r["text"], r["copies"], r["fault"])
        _, audit = min(v for s, v in _best(block).items() if s in ACCEPTING)
        replay = Replay(audit)
        shown = [x for _, role, text, n, _ in block.rows for _ in range(n) for x in replay.row(role, text)] + list(replay.inserts())
        return pa.table({"conv_id": pa.array([block.conv_id] * len(shown), pa.int64()), "at": pa.array(range(len(shown)), pa.int64()), "role": pa.array([r for r, _ in shown], pa.string()), "text": pa.array([t for _, t in shown], pa.string())})

    return faults(copies).groupBy("conv_id").applyInArrow(run, "conv_id long, at long, role string, text string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
