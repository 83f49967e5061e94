"""Structure repair, nearest neighbours and lexical search against brute force."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from hydrosheaf.llm import lexical, neighbours, ngram_join, repair

# --- structure repair ---


def least_edits(symbols):
    step = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}

    @functools.lru_cache(None)
    def go(i, state, inserted):
        out = [(0, "")] if i == len(symbols) and state in "0A" else []
        if i < len(symbols):
            x = symbols[i]
            more, own = 3 * x.isupper(), x.lower()
            moves = [(4, "D", state)]
            if x != "#":
                moves += [(more, "K", step[state][own])] if own in step[state] else []
                moves += [(more + 3, "R", step[state][t]) for t in "ua" if t in step[state] and t != own]
            for cost, mark, to in moves:
                c, a = go(i + 1, to, 0)
                out.append((cost + c, mark + a))
        if inserted < 3:
            for t in "ua":
                if t in step[state]:
                    c, a = go(i, step[state][t], inserted + 1)
                    out.append((3 + c, "I" + a))
        return min(out, default=(10**9, ""))

    return go(0, "0", 0)


def test_edits_are_the_least_for_every_short_sequence_and_every_cut():
    table = lambda part: {top: repair.block_table(part, top) for top in repair.STACKS}
    for size in range(4):
        for symbols in map("".join, itertools.product("suaxSUAX#", repeat=size)):
            assert repair.chained([table(symbols)] if symbols else []) == least_edits(symbols)
    rng = random.Random(3)
    for _ in range(400):
        symbols = "".join(rng.choice("suaxUA#ua") for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(symbols) + 1) for _ in range(rng.randrange(5)))
        parts = [p for p in (symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])) if p]
        assert repair.chained([table(p) for p in parts]) == least_edits(symbols)


def by_hand(rows):
    """The contract for (conv_id, turn, role, text) rows, damage included."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = role if role is not None else " ", text if text is not None else " "
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn is not None, turn or 0, "user" if k == 4 else role, hashlib.sha256(text.encode()).hexdigest(), text, turn)] * (0 if k == 0 else 2 if k == 3 else 1)
        kept.sort(key=lambda r: r[:4])
        seen, symbols, count = set(), "", collections.Counter()
        for _, _, role, sha, text, _ in kept:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, sha) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, sha))
            count[fault] += 1
            own = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "#" if fault in ("blank", "duplicate") else own.upper() if fault else own
        cost, audit = least_edits(symbols)
        turns = {r[5] for r in kept if r[5] is not None}
        roles = [r[2][:1] for r in kept]
        lines, at, size = [], 0, sum(x != "D" for x in audit)
        for x in audit:
            role, text = kept[at][2:5:2] if x != "I" else ("", "")
            at += x != "I"
            if x != "D":
                place = len(lines) - size % 2
                lines.append(f"{role if x == 'K' else ('user', 'assistant')[place % 2]}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, audit string, kind int"


@pytest.mark.parametrize("block", [repair.BLOCK, 3])
def test_repair_of_damaged_tables(spark, monkeypatch, block):
    """With blocks of three turns every conversation is chained from several."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(-3, 60)]:
        for turn in range(rng.randrange(0, 14)):
            turn = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2])
            text = rng.choice(["Yes.", "No", "", None, " \n", "What? ", "é漢。", "Well. " * rng.randrange(1, 9), "x" * 3000 + "."])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "", "Tool"] + ["user", "assistant"] * 3), text))
        if rows and rng.random() < 0.2:
            rows.append(rows[-1])
    rows += [(99, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONVERSATIONS).repartition(3)
    damaged = repair.damaged(df)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.digest(damaged, repair.plans(damaged)).collect()}
    assert got == by_hand(rows)
    assert repair.plans(repair.damaged(df.limit(0))).count() == 0


def test_repaired_turns_are_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye."), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = [tuple(r) for r in repair.repaired(repair.whole(df)).orderBy("conv_id", "pos").collect()]
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", ""), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye."), (1, 4, "assistant", "")]


# --- nearest neighbours ---

VECTORS = "vec_id bigint, embedding array<float>, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], VECTORS).repartition(3)


def nearest_by_hand(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    size = collections.Counter(len(v) for _, v in good)
    d = max(size, key=lambda s: (size[s], s)) if size else 0
    good = [(i, v) for i, v in good if len(v) == d]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            found = sorted((-float(np.add.reduce(w * v)), j) for b, (j, w) in enumerate(good) if a != b)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return out


def test_few_and_awkward_vectors_are_searched_whole(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(12)]
    rows += [(20, rows[3][1]), (20, rows[3][1]), (40, rows[0][1]), (60, [9.0, 9.0, 9.0, 9.0, 9.0]), (None, rows[1][1]), (80, None), (100, [0.0] * 5), (120, [1.0, None, 1.0, 1.0, 1.0]),
             (140, [1.0, float("nan"), 1.0, 1.0, 1.0]), (160, [float("inf")] * 5), (180, [1.0, 2.0]), (200, [])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(vectors(spark, rows)).collect())
    assert got == sorted(nearest_by_hand(rows, 20, 20))
    assert neighbours.nearest(vectors(spark, [])).count() == 0 and neighbours.nearest(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    assert neighbours.nearest(vectors(spark, [(20, [1.0, 2.0])])).count() == 0


def test_recall_of_clustered_vectors_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24)) * 2
    x = centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 24))
    x[500:900] = x[20]                                    # one vector holds a large part of the rows
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(vectors(spark, rows), k=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = collections.defaultdict(list)
    for i, r, j, s in nearest_by_hand(rows, 10, 20):
        want[i].append((r, j, s))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    share = np.mean([len({j for _, j, _ in got[i]} & {j for _, j, _ in want[i]}) / 10 for i in want])
    assert share >= 0.9
    for i in got:                                         # ranks, ties and scores are exact for what is found
        assert [r for r, _, _ in sorted(got[i])] == list(range(1, 11))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(sorted(got[i]), sorted(got[i])[1:]))
    assert sorted(got[20]) == sorted(want[20])


def test_tests_abandon_far_rows_and_keep_near_ones():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    lists = neighbours.Lists(x, len(x), float(np.linalg.norm(x, axis=1).max()))
    asked = rng.standard_normal((20, 64))
    floor = np.sort(x @ asked.T, axis=0)[-10]
    q, r = neighbours.survivors(lists, x, asked, floor)
    near = np.stack(np.nonzero((x @ asked.T).T >= floor[:, None]))
    kept = set(zip(q.tolist(), r.tolist()))
    assert np.mean([p in kept for p in zip(*near.tolist())]) > 0.99 and len(kept) <= len(near[0])


# --- lexical search ---

WORD = re.compile(lexical.PATTERN)


def ranked_by_hand(docs, items, top=10):
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := low(t))]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = collections.Counter(w for _, c, _ in texts for w in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in texts:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, k in collections.Counter(low(text)).items() if w in c)
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item, r, i if z else None, -s) for r, (s, z, i) in enumerate(sorted(found)[:top], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 4000, "PIECE": 700, "POSTINGS": 4, "WINDOW": 3, "ITEMS": 2}])
def test_rankings_are_those_of_brute_force(spark, docs, rows, no_docs, monkeypatch, sizes):
    """Also with many shards, blocks and windows, and texts read in pieces."""
    index, search = lexical.index, lexical.search
    if sizes:
        def _sized(batches):
            for k, v in sizes.items():
                setattr(lexical, k, v)
            yield from lexical._indexed(batches)

        place = "concat_ws(':', spark_partition_id(), monotonically_increasing_id()) AS place"
        index = lambda d: d.selectExpr(place, "doc_id", "coalesce(text, '') AS text").mapInArrow(_sized, lexical._INDEX_DDL)
        monkeypatch.setattr(lexical, "ITEMS", 2)
    texts = [(r[0], r[1]) for r in rows]
    items = [(1, rows[60][1]), (1, rows[60][1]), (1, rows[70][1][:80]), (2, None), (3, ""), (4, "ONE One two é漢字"), (None, rows[9][1]), (5, "absent words"), (6, rows[-3][1][:300] if rows[-3][1] else "ka")]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, term string")
    got = collections.Counter(tuple(r) for r in search(index(docs), table).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked_by_hand(texts, items)
    assert search(index(no_docs), table).count() == 0 and search(index(docs), table.limit(0)).count() == 0


def test_blocks_unpack_to_what_was_packed():
    rng = np.random.default_rng(3)
    doc = np.concatenate([np.sort(rng.choice(10**6, 300, replace=False)), np.arange(5)])
    tf = np.concatenate([rng.integers(1, 70_000, 300), np.ones(5, np.int64)])
    start = np.array([0, 128, 256, 300])
    raw, ends, top = lexical.packed(doc, tf, start)
    for a, b, x, y, t in zip(start, [128, 256, 300, 305], [0, *ends], ends, top):
        d, f = lexical.unpacked(raw[x:y].tobytes(), b - a)
        assert (d == doc[a:b]).all() and (f == tf[a:b]).all() and t == tf[a:b].max()


# --- rows that repeat an id ---


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, c), (9, c), (None, c), (7, None), (7, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, _row int").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.representatives(df, 5, 80).collect())
    assert got == collections.Counter([(1, a), (5, b), (9, c), (7, None), (7, "")])
