"""Conversation structure repair by a generalised LR parser with weighted edits.

A grammar of roles, ``(s?(ua)+)?`` over the initials of system, user and assistant, is turned into
LR(0) tables.  The parser reads the rows of a conversation in order; at each row it may insert a user
or assistant turn, delete the row, give it the other role, or keep it.  Every choice branches the
stack, and stacks are nodes of a graph that share what lies below them.  Nodes with equal stack tops
after the same row are merged into the one of least (cost, audit): stacks with equal tops accept the
same continuations in this grammar, and of two audits of equal cost over the same rows none begins
with the other, so no later edit turns their order.

A conversation may hold any number of rows.  They are dealt into blocks of ``BLOCK`` turns; the parser
runs over each block from every stack top it can begin with, which gives a small table of (cost, audit)
by first and last top.  Tables of a conversation are chained: costs to go from the last block back, then
the least choice forward.  Insertions stand before a row, those after the last row at the end, so an
audit has one cut per block and the chain is exact.  One task sees a row per block of a conversation,
never its texts; only the digest of the repaired conversation, being sequential, streams its rows.

Defined cases: null texts and roles are one space, as null ids are inside the damage key; a null turn
comes first; rows of one turn are ordered by role, then by the digest of their text; repeated rows are
duplicates; a null conv_id is a conversation of its own; a conversation without rows has zeros and an
empty audit; of an empty table there is no row; further columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3     # costs; a truncated row that stays adds TRUNCATED
TRUNCATED = 3
NAMES = {"u": "user", "a": "assistant"}
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "E"), ("P", "PE"), ("E", "ua"))
START = "C"


class Tables:
    """LR(0) tables: ``step`` of (state, symbol), ``reduce`` of a state, and the accepting state."""

    def __init__(self, grammar=GRAMMAR, start: str = START):
        self.rules = [(start + "'", start), *grammar]
        heads = {h for h, _ in self.rules}
        first = self._close({(0, 0)}, heads)
        self.states, self.step, todo = [first], {}, [0]
        while todo:
            at = todo.pop()
            for symbol in sorted({self.rules[r][1][dot] for r, dot in self.states[at] if dot < len(self.rules[r][1])}):
                items = self._close({(r, dot + 1) for r, dot in self.states[at] if self.rules[r][1][dot:dot + 1] == symbol}, heads)
                if items not in self.states:
                    self.states.append(items)
                    todo.append(len(self.states) - 1)
                self.step[at, symbol] = self.states.index(items)
        self.accept = self.step[0, start]
        self.reduce = {i: [(self.rules[r][0], len(self.rules[r][1])) for r, dot in sorted(items) if r and dot == len(self.rules[r][1])] for i, items in enumerate(self.states)}
        self.tokens = sorted({x for _, body in self.rules for x in body if x not in heads})
        self.open = [i for i in range(len(self.states)) if any((i, t) in self.step for t in self.tokens)]

    def _close(self, items: set, heads: set) -> frozenset:
        todo = list(items)
        while todo:
            r, dot = todo.pop()
            symbol = self.rules[r][1][dot:dot + 1]
            for k, (head, _) in enumerate(self.rules):
                if symbol in heads and head == symbol and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)


class Node:
    """A stack top in the graph of stacks: its state, what brought it there, and the stack below."""

    __slots__ = ("state", "cost", "audit", "below")

    def __init__(self, state: int, cost: int, audit: str, below):
        self.state, self.cost, self.audit, self.below = state, cost, audit, below


LR = Tables()


def _merge(tops: dict[int, Node], node: Node) -> bool:
    """Keep the least of equal tops; whether ``node`` is it."""
    had = tops.get(node.state)
    if had is not None and (had.cost, had.audit) <= (node.cost, node.audit):
        return False
    tops[node.state] = node
    return True


def _reduced(nodes: list[Node]) -> dict[int, Node]:
    """All tops that reductions reach from these, merged."""
    tops: dict[int, Node] = {}
    todo = [n for n in nodes if _merge(tops, n)]
    while todo:
        node = todo.pop()
        if tops[node.state] is not node:
            continue
        for head, size in LR.reduce[node.state]:
            base = node
            for _ in range(size):
                base = base.below
            goto = LR.step.get((base.state, head))
            if goto is not None:
                made = Node(goto, node.cost, node.audit, base)
                if _merge(tops, made):
                    todo.append(made)
    return tops


def _shifted(node: Node, token: str, cost: int, mark: str) -> Node | None:
    goto = LR.step.get((node.state, token))
    return None if goto is None else Node(goto, node.cost + cost, node.audit + mark, node)


def _inserted(tops: dict[int, Node]) -> dict[int, Node]:
    """Tops with any number of turns inserted; a loop of insertions never pays."""
    while True:
        more = [m for n in tops.values() for t in NAMES if (m := _shifted(n, t, INSERT, "I"))]
        grown = _reduced([*tops.values(), *more])
        if all(grown[s] is tops.get(s) for s in grown):
            return tops
        tops = grown


def _stacks() -> dict[int, Node]:
    """The shortest stack of each top that can take another token."""
    def states(n: Node | None) -> tuple[int, ...]:
        return (*states(n.below), n.state) if n else ()

    todo, found = [Node(0, 0, "", None)], {}
    seen = {states(todo[0])}
    for at in todo:
        found.setdefault(at.state, at)
        for t in LR.tokens:
            made = _shifted(at, t, 0, "")
            for n in _reduced([made]).values() if made else ():
                if states(n) not in seen:
                    seen.add(states(n))
                    todo.append(n)
    return {s: found[s] for s in LR.open if s in found}


STACKS = _stacks()


def _run(symbols: str, first: int) -> tuple[tuple[int, int, str], ...]:
    below = STACKS[first]
    tops = _reduced([Node(first, 0, "", below.below)])
    for x in symbols:
        made = []
        for n in _inserted(tops).values():
            made.append(Node(n.state, n.cost + DELETE, n.audit + "D", n.below))
            if x == "#":
                continue
            more = TRUNCATED if x.isupper() else 0
            own = x.lower()
            if kept := _shifted(n, own, KEEP + more, "K"):
                made.append(kept)
            made += [m for t in NAMES if t != own and (m := _shifted(n, t, REROLE + more, "R"))]
        tops = _reduced(made)
    return tuple(sorted((s, n.cost, n.audit) for s, n in tops.items() if s in STACKS))


_run_short = lru_cache(maxsize=1 << 15)(_run)


def block_table(symbols: str, first: int) -> tuple[tuple[int, int, str], ...]:
    """(last top, cost, audit) of the least edits over a block begun with stack top ``first``.

    A symbol is the initial of a role (``x``: neither of s, u, a), a capital where the row is truncated,
    ``#`` where the row has to go.
    """
    return (_run_short if len(symbols) <= 16 else _run)(symbols, first)


@lru_cache(maxsize=None)
def ending(top: int) -> tuple[int, str] | None:
    """Least insertions after the last row that let the stack be accepted."""
    tops = _inserted(_reduced([Node(top, 0, "", STACKS[top].below)]))
    done = _reduced(list(tops.values())).get(LR.accept)
    return None if done is None else (done.cost, done.audit)


def chained(blocks: list[dict[int, tuple[tuple[int, int, str], ...]]]) -> tuple[int, str]:
    """Least (cost, audit) over the block tables of a conversation, in order."""
    togo = {s: e[0] for s in STACKS if (e := ending(s)) is not None}
    after = [togo]
    for table in reversed(blocks):
        togo = {s: min(c + togo[t] for t, c, _ in exits if t in togo) for s, exits in table.items() if any(t in togo for t, _, _ in exits)}
        after.append(togo)
    after.reverse()
    top, audit = 0, []
    for k, table in enumerate(blocks):
        _, piece, top = min((c + after[k + 1][t], a, t) for t, c, a in table[top] if t in after[k + 1])
        audit.append(piece)
    return after[0][0], "".join([*audit, ending(top)[1]])


# --- damage and faults ----------------------------------------------------------------------------


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text, gone): rows after damage; dropped ones stay, marked ``gone``."""
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    base = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("k"),
        _or_space("role").alias("role"), _or_space("text").alias("text"),
    )
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return base.select(
        "conv_id", F.coalesce("turn", F.lit(-(1 << 63))).alias("at"), "turn",
        F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The columns of ``damaged`` for a table that is repaired as it is."""
    turn = F.col("turn").cast("bigint")
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(turn, F.lit(-(1 << 63))).alias("at"), turn.alias("turn"),
        _or_space("role").alias("role"), _or_space("text").alias("text"), F.lit(False).alias("gone"))


_SPACES = " \t\n\x0b\x0c\r"


def _light(rows: DataFrame) -> DataFrame:
    """Rows without their texts: digest, blank and truncated marks."""
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    blank = F.length(end) == 0
    return rows.select(
        "conv_id", "at", "turn", "role", F.sha2("text", 256).alias("sha"), "gone", blank.alias("blank"),
        (~blank & ~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


def _with_repeats(light: DataFrame) -> DataFrame:
    """Adds ``seen``: the row's role and text stand at an earlier turn of the conversation."""
    key = ["conv_id", "role", "sha"]
    firsts = (
        light.filter(~F.col("gone")).groupBy(*key).agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
        .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s"))
    return light.join(firsts, same, "left").withColumn("seen", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("_c", "_r", "_s", "first")


_TOPS = tuple(STACKS)
_BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("blk", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
    ("ends", pa.list_(pa.list_(pa.int64()))), ("audits", pa.list_(pa.list_(pa.string()))),
])
_BLOCKS_DDL = ("conv_id bigint, blk bigint, part bigint, n bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
               "illegal bigint, head string, tail string, ends array<array<bigint>>, audits array<array<string>>")
_LEGAL = ("su", "ua", "au")


class _Block:
    def __init__(self, conv, blk, part, last=None):
        self.conv, self.blk, self.part, self.last, self.symbols, self.initials, self.turns = conv, blk, part, last, [], [], []
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, row) -> None:
        at, turn, role, sha, blank, cut, seen = row
        same, self.last = (at, role, sha) == self.last, (at, role, sha)
        fault = "blank" if blank else "duplicate" if seen or same else "truncated" if cut else None
        if fault:
            self.count[fault] += 1
        first = role[:1]
        self.initials.append(first)
        own = first if first in ("s", "u", "a") else "x"
        self.symbols.append("#" if fault in ("blank", "duplicate") else own.upper() if fault else own)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def row(self, before) -> dict:
        """``before`` is the last turn of the part before this one, in the same block."""
        symbols, ends, audits = "".join(self.symbols), [], []
        if symbols:
            for first in _TOPS:
                found = block_table(symbols, first)
                ends.append([x for s, c, _ in found for x in (s, c)])
                audits.append([a for _, _, a in found])
        i = self.initials
        return {
            "conv_id": self.conv, "blk": self.blk, "part": self.part, "n": len(symbols), "low": self.turns[0] if self.turns else None,
            "high": self.turns[-1] if self.turns else None, "turns": len(self.turns) - (bool(self.turns) and self.turns[0] == before), **self.count,
            "illegal": sum(a + b not in _LEGAL for a, b in zip(i, i[1:])), "head": i[0] if i else None, "tail": i[-1] if i else None,
            "ends": ends, "audits": audits,
        }


def _summed(batches):
    """Sorted light rows to one row per block, cut into parts of ``BLOCK`` rows."""
    now, before, out = None, None, []
    for batch in batches:
        for conv, blk, at, turn, role, sha, gone, blank, cut, seen in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or (conv, blk) != (now.conv, now.blk):
                if now is not None:
                    out.append(now.row(before))
                now, before = _Block(conv, blk, 0), None
            if gone:
                continue
            if len(now.symbols) >= BLOCK:
                out.append(now.row(before))
                before = now.turns[-1] if now.turns else before
                now = _Block(conv, blk, now.part + 1, now.last)
            now.add((at, turn, role, sha, blank, cut, seen))
        if len(out) >= 256:
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)
            out = []
    if now is not None:
        out.append(now.row(before))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)


_PLANS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_PLANS_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _planned(batches):
    """Sorted block rows to one row per conversation."""
    now, tables, total, out = object(), [], {}, []

    def close():
        cost, audit = chained(tables)
        gaps = total["high"] - total["low"] + 1 - total["turns"] if total["low"] is not None else 0
        out.append({"conv_id": now, "gaps": gaps, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit})

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_id"] != now:
                if total:
                    close()
                now, tables = r["conv_id"], []
                total = {"turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "low": None, "high": None, "tail": None}
            if not r["n"]:
                continue
            for c in ("turns", "blank", "duplicate", "truncated", "illegal"):
                total[c] += r[c]
            if total["tail"] is not None and total["tail"] + r["head"] not in _LEGAL:
                total["illegal"] += 1
            total["tail"] = r["tail"]
            if r["low"] is not None:
                total["low"] = r["low"] if total["low"] is None else total["low"]
                total["high"] = r["high"]
            tables.append({s: tuple(zip(e[::2], e[1::2], a)) for s, e, a in zip(_TOPS, r["ends"], r["audits"])})
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema=_PLANS)
            out.clear()
    if total:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PLANS)


def plans(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of the least repair per conversation of ``damaged`` or ``whole`` rows."""
    light = _with_repeats(_light(rows)).select("conv_id", F.expr(f"at div {BLOCK}").alias("blk"), "at", "turn", "role", "sha", "gone", "blank", "cut", "seen")
    blocks = light.repartition("conv_id", "blk").sortWithinPartitions("conv_id", "blk", "at", "role", "sha").mapInArrow(_summed, _BLOCKS_DDL)
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "blk", "part").mapInArrow(_planned, _PLANS_DDL)


def edited(audit: str):
    """(edit, role of the result or None) in the order of an audit."""
    size = sum(x != "D" for x in audit)
    k = size % 2            # an odd result begins with the system turn
    role = 0
    for x in audit:
        if x == "D":
            yield x, None
        else:
            yield x, ("system" if role < k else "ua"[(role - k) % 2])
            role += 1


def _told(batches):
    """Plans and rows in order of conversations to repaired turns: (conv_id, plan, pos, role, text)."""
    now, steps, pos, out, size = None, iter(()), 0, [], 0

    def emit(conv, role, text):
        nonlocal pos, size
        out.append({"conv_id": conv, "pos": pos, "role": role, "text": text})
        pos, size = pos + 1, size + len(text)

    def inserted():
        """The next edit of a row; inserted turns before it are emitted."""
        for x, role in steps:
            if x != "I":
                return x, role
            emit(now, NAMES[role], "")
        return None, None

    for batch in batches:
        for conv, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]):
            if audit is not None:
                inserted()
                now, steps, pos = conv, edited(audit), 0
                continue
            x, new = inserted()
            if x != "D":
                emit(conv, NAMES[new] if x == "R" else role, text)
        if size > 4 << 20 or len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema=_TURNS)
            out, size = [], 0
    inserted()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_TURNS)


_TURNS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _in_order(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """A plan before the rows of its conversation, sorted within partitions by conversation."""
    heads = planned.select("conv_id", "audit", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"))
    tails = rows.filter(~F.col("gone")).select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"), "at", "role", "text")
    every = heads.unionByName(tails).withColumn("sha", F.sha2("text", 256))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at", "role", "sha").select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, pos, role, text."""
    return _in_order(rows, plans(rows) if planned is None else planned).mapInArrow(_told, "conv_id bigint, pos bigint, role string, text string")


def _hashed(batches):
    now, started, sha, out = None, False, hashlib.sha256(), []

    def close():
        out.append({"conv_id": now, "repaired_sha256": sha.hexdigest()})

    for batch in batches:
        for conv, pos, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")]):
            if pos == 0:
                if started:
                    close()
                now, started, sha = conv, True, hashlib.sha256()
            sha.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema=_SHAS)
            out.clear()
    if started:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_SHAS)


_SHAS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Plans with the digest of the repaired ``role:text`` lines."""
    shas = repaired(rows, planned).mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string").withColumnRenamed("conv_id", "_c")
    return planned.join(shas, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY)))
