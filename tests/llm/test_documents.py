"""Operators over documents against brute force."""

import collections
import hashlib
import re
import zlib

import pytest

from hydrosheaf.llm import decontam, licenses, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, words, percent):
    sets = {r[0]: shingles(r[1], words) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("frequent,block", [(16, 1500), (3, 4)])
def test_join_finds_every_group(docs, rows, monkeypatch, frequent, block):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    want = groups(rows, 4, 85)
    got = ngram_join.joined(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_join_of_nothing(no_docs):
    assert ngram_join.joined(no_docs).count() == 0
    assert ngram_join.representatives(no_docs).columns == no_docs.columns


def test_one_document_of_each_group_stays(docs, rows):
    want = groups(rows, 5, 80)
    got = ngram_join.representatives(docs, 5, 80)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})
    assert ids.count(None) == 2


def test_signatures_meet_for_every_linked_pair():
    """The prefix argument itself, over sets that differ by as much as a link allows."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 7, 8, 13, 20, 57, 100, 400):
        for _ in range(8):
            universe = np.unique(rng.integers(1, 1 << 62, 3 * n + 8, dtype=np.uint64))
            x = universe[:n]
            drop = rng.integers(0, max(1, n * 15 // 100) + 1)
            y = np.concatenate((x[drop:], universe[n: n + rng.integers(0, max(1, n * 17 // 100) + 1)]))
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (n + len(y) - common) or len(x) == len(y) == common:
                continue
            for share in (0.0, 0.5, 1.0):
                frequent = set(rng.choice(universe, int(share * len(universe)), replace=False).tolist())
                keys = []
                for s in (np.sort(x), np.sort(y)):
                    f = np.array([v in frequent for v in s.tolist()])
                    keys.append(ngram_join.signatures(len(s), s[~f], s[f]))
                assert len(np.intersect1d(*keys)), (n, share)


def test_texts_of_one_template_are_split_and_blocks_bounded(spark, monkeypatch):
    """A bucket of template texts that don't link: few rows, bounded groups, planted links still meet."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    m, template = 400, list(range(1, 89))
    own = {i: [1000 * (1 + i // 2) + j for j in range(6)] + [10**6 * (1 + (i + 1) // 2 % 200) + j for j in range(6)] for i in range(m)}     # each own shingle in two texts
    sets = {i: template + own[i] for i in range(m)}
    sets[m] = sets[7][:88] + sets[7][88:] + [5 * 10**8]                   # links with 7
    sets[m + 1] = sets[9][3:] + own[201][:1]                              # links with 9
    df = collections.Counter(t for x in sets.values() for t in x)
    order = {t: int(ngram_join.tb.mix(np.array([t], np.uint64)).view(np.int64)[0]) for t in df}
    shared = spark.createDataFrame([(i, len(x), [order[t] for t in x if df[t] > 1], [df[t] for t in x if df[t] > 1]) for i, x in sets.items()],
                                   "node bigint, n bigint, tokens array<bigint>, df array<bigint>")
    member = lambda comp: spark.createDataFrame([(1, i, 0, comp(i)) for i in sets], "sig bigint, node bigint, extra bigint, comp bigint")
    groups = collections.defaultdict(list)
    for r in ngram_join.blocked(member(lambda i: i), shared, 85).collect():
        groups[r.sig, r["sub"], r.line, r.block].append(r)
    assert sum(map(len, groups.values())) < 8 * m             # blocks alone: more than 10 m rows, 400 in each group
    assert max(map(len, groups.values())) <= 2 * 40
    assert sum(sum(r.probe for r in g) * sum(r.target for r in g) for g in groups.values()) < 30 * m
    for pair in ((7, m), (9, m + 1)):
        assert any({r.node for r in g if r.probe or r.target} >= set(pair) and any(r.probe and r.node in pair for r in g) for g in groups.values())
    # few outside members: one line, every outside member meets every member
    met = ngram_join.blocked(member(lambda i: 500 + i if i < 30 else 0), shared, 85).collect()
    assert max(collections.Counter((r["sub"], r.line, r.block) for r in met).values()) <= 2.5 * 40
    block, probes = {r.node: r.block for r in met if r.target}, {(r.block, r.node) for r in met if r.probe}
    assert block.keys() == sets.keys() and len({i for _, i in probes}) <= 30
    assert all((block[k], i) in probes for _, i in probes for k in sets)


def test_finer_keys_meet_for_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 20, 57, 100, 401):
        for _ in range(40):
            universe = rng.permutation(np.unique(rng.integers(1, 1 << 62, 3 * n + 8, dtype=np.uint64)))
            x = universe[:n]
            drop = rng.integers(0, max(1, n * 15 // 100) + 1)
            y = np.concatenate((x[drop:], universe[n: n + rng.integers(0, max(1, n * 17 // 100) + 1)]))
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (n + len(y) - common):
                continue
            unique = set(rng.choice(universe, len(universe) // 2).tolist()) - set(np.intersect1d(x, y).tolist())
            keys = [ngram_join.finer(len(s), np.sort(np.array([t for t in s.tolist() if t not in unique], np.uint64))) for s in (x, y)]
            (a, p), (b, q) = keys
            sides = {(int(p[i]), int(q[j])) for i, k in enumerate(a) for j in np.flatnonzero(b == k)}
            assert sides & {(0, 0), (1, 2), (2, 1)}, (n, len(y), common)


def test_suffix_sorting_removes_what_earlier_documents_hold(docs, rows):
    got = collections.defaultdict(list)
    for r in suffix_dedup.deduplicated(docs, True).collect():
        got[r.doc_id].append(r)
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p:p + 50], r[0]) < r[0]:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        for g in got[r[0]]:
            assert (g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) == (len(raw), sum(gone), spans, kept), r[0]
            assert g.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert sum(map(len, got.values())) == len(rows)
    assert all(g.n_removed == 0 for g in got[None])


def test_suffix_sorting_tells_rows_of_one_id_apart(spark):
    import random

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, other, shared = text(200), text(400), text(80)
    rows = [(1, base), (2, "zzzz " + base + text(90)), (2, other), (2, "short"), (2, None), (3, other), (3, text(70) + shared), (3, shared + text(60)),
            (3, text(60) + shared), (3, base), (4, text(30) + shared + text(30)), (4, base[:150] + text(40)), (5, other), (5, other)]
    starts = {}
    for doc, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            starts[raw[p:p + 50]] = min(starts.get(raw[p:p + 50], doc), doc)
    want = []
    for doc, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if starts[raw[p:p + 50]] < doc:
                gone[p:p + 50] = b"\1" * 50
        want.append((doc, len(raw), bytes(b for b, g in zip(raw, gone) if not g)))
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), True).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == sorted(want)


def test_suffix_sorting_of_nothing(no_docs):
    assert suffix_dedup.deduplicated(no_docs).count() == 0


def test_blind_trie_orders_strings():
    import random

    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie(12)
    for i, t in enumerate(texts):
        trie.add(t, i)
    order = [g for g in trie.ordered()]
    assert [texts[g[0]] for g in order] == sorted(set(texts))
    assert all(len({texts[i] for i in g}) == 1 for g in order)


def brute_hits(text, items, window=10):
    w, covered, found = decontam.words(text), set(), set()
    for item, seq in items:
        n = min(len(seq), window)
        for k in range(len(seq) - n + 1):
            for i in range(len(w) - n + 1):
                if n and w[i:i + n] == seq[k:k + n]:
                    covered.update(range(i, i + n))
                    found.add(item)
    return len(w), len(covered), found


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    texts = {r[0]: r[1] for r in rows}
    a, b = texts[10].split(), texts[70].split()
    items = [(1, " ".join(a[5:30])), (2, " ".join(b[:14]).upper()), (10, "one"), (11, "A, b. C!"), (12, None), (13, ""), (14, "..."), (15, "漢字"),
             (2, " ".join(b[:14])), (16, " ".join(a[20:31]))]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_decontamination_against_windows(docs, rows, benchmark, limit):
    items, table = benchmark
    lists = [(i, decontam.words(t)) for i, t in items]
    some = docs.filter("doc_id IS NULL OR doc_id < 119")
    got = decontam.digest(decontam.contaminated(some, table, limit)).collect()
    want = {r[0]: brute_hits(r[1], lists) for r in rows if r[0] is not None and r[0] < 119}
    assert len(got) == sum(1 for r in rows if r[0] is None or r[0] < 119)
    for r in got:
        if r.doc_id is None:
            continue
        n, hit, found = want[r.doc_id]
        names = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0), r
        assert r.items_sha256 == hashlib.sha256(names.encode()).hexdigest()


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_decontaminated_texts(spark, docs, rows, benchmark, no_docs, limit):
    items, table = benchmark
    out = decontam.removed(docs, table, limit=limit)
    assert out.columns == docs.columns
    lists = [(i, decontam.words(t)) for i, t in items if len(decontam.words(t)) >= 10]
    kept = {r.doc_id: r.text for r in out.collect()}
    for r in rows:
        n, hit, _ = brute_hits(r[1], [(i, decontam.words(t)) for i, t in items]) if r[0] not in (120, 121) else (1, 0, set())
        if not hit and r[0] is not None:
            assert kept[r[0]] == r[1]
        if hit > 0.5 * n and r[0] is not None:
            assert r[0] not in kept
    assert all(brute_hits(t, lists)[1] == 0 for i, t in kept.items() if i not in (120, 121, None))
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.removed(docs, empty, limit=limit).count() == len(rows)
    assert decontam.contaminated(no_docs, table, limit).count() == 0


def test_quality_counts(docs, rows):
    got = collections.defaultdict(list)
    for r in quality.judged(docs).collect():
        got[(r.doc_id, r.text)].append(r)
    for r in rows:
        w = spaced(r[1])
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r[1] or "").split("\n") if spaced(x)]
        for g in got[(r[0], r[1])]:
            assert (g.n_words, g.word_chars, g.n_repeat_words) == (len(w), sum(map(len, w)), len(cover)), r[0]
            assert g.n_symbols == len(re.findall(r"[#*$%&|<>]", r[1] or "")) and g.n_dup_lines == len(lines) - len(set(lines))
            assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_line_rules(spark, no_docs):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    good = "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(14))
    bad = {
        "punctuation": "this*** line%%% is### full&&& of$$$ signs***",
        "loud": "BUY!! this!! now!! or!! regret!! it",
        "shouting": "EVERYTHING IN THIS LINE IS WRITTEN IN CAPITALS",
        "navigation": "Home | News | Sport | Weather | Contact",
        "boilerplate": "Copyright (c) 2020 Someone. All rights reserved.",
    }
    rows = [(0, good)] + [(k + 1, good + "\n" + x) for k, x in enumerate(bad.values())] + [(9, "\n".join([*bad.values()] * 4 + [good]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in quality.cleaned(df).collect()}
    assert set(out) == set(range(6)) and set(out.values()) == {good}
    assert quality.judged(no_docs).count() == 0


def test_license_lines(spark, docs, no_docs):
    lines = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "released under the mit license"), (3, "nothing here"), (4, None), (5, ""),
             (6, "\n".join(["All rights reserved."] * 3)), (7, "This work is licensed under the GNU General Public License, version 3.")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(lines, "doc_id bigint, text string")).collect()}
    assert set(got) == {(1, "Apache-2.0"), (2, "MIT"), (6, "all-rights-reserved"), (7, "GPL-3.0")}
    assert got[(6, "all-rights-reserved")].n_lines == 3 and got[(1, "Apache-2.0")].dice == 1.0
    assert licenses.scan(docs).count() == 0 and licenses.scan(no_docs).count() == 0
    for n in range(1, 40):                      # the bounds are those of the coefficient
        lo, hi = licenses.bounds(n)
        fits = [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= licenses.LEAST]
        assert (lo, hi) == (fits[0], fits[-1])


def test_license_passages(spark):
    import textwrap

    import duckdb

    from hydrosheaf.llm import queries

    text = {name: [t for n, t in licenses.TEMPLATES if n == name] for name, _ in licenses.TEMPLATES}
    plain = "the river rose in spring and fell again before the summer came to the lower valley"
    mit, bsd2, bsd3 = max(text["MIT"], key=len), text["BSD-2-Clause"][0], max(text["BSD-3-Clause"], key=len)
    gpl = text["GPL-3.0"][1]
    rows = [
        (1, "Copyright 2020 Foo. Licensed under CC BY 4.0. See the site for details."),
        (2, plain + "\n" + "\n".join("# " + x for x in textwrap.wrap(gpl, 40)) + "\n" + plain),
        (3, plain + "\n" + "\n".join(textwrap.wrap(mit, 60)) + "\n" + plain),
        (4, bsd3), (5, plain + " " + bsd2 + " " + plain), (6, plain + "\n" + mit[:420]),
        (7, (plain + ". All rights reserved. ") * 3), (8, mit + "\n" + gpl + "\n" + bsd3), (9, (plain + " ") * 2000 + gpl + " " + plain),
        (10, "license software permission granted free of charge to the public " * 40), (None, gpl), (None, gpl), (11, "MIT"), (12, "under the GNU General Public License"), (13, None), (14, ""),
        (15, ("Released under the MIT License. " + plain + "\n") * 300),
        (16, gpl.replace("redistribute", "share").replace("Foundation", "Trust")),
    ]
    df = spark.createDataFrame([r + ("x", 1, True) for r in rows], "doc_id bigint, text string, license string, dice int, whole boolean").repartition(3)
    got = {(r.doc_id, r.license): r for r in licenses.scan(df).collect()}
    places = {k: r.n_places for k, r in got.items() if r.n_places}
    assert places == {
        (1, "CC-BY-4.0"): 1, (2, "GPL-3.0"): 1, (3, "MIT"): 1, (4, "BSD-3-Clause"): 1, (5, "BSD-2-Clause"): 1, (6, "MIT"): 1, (7, "all-rights-reserved"): 3,
        (8, "MIT"): 1, (8, "GPL-3.0"): 1, (8, "BSD-3-Clause"): 1, (9, "GPL-3.0"): 1, (None, "GPL-3.0"): 2, (15, "MIT"): 300, (16, "GPL-3.0"): 1}
    assert got[(2, "GPL-3.0")].dice == got[(9, "GPL-3.0")].dice == 1.0 and got[(16, "GPL-3.0")].dice < 1.0 and got[(4, "BSD-3-Clause")].whole
    con = duckdb.connect()
    con.register("fixture", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(queries.license_sql("fixture")).fetchall()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.license, round(r.dice, 9), r.n_lines, r.n_places, r.whole)) for r in got.values())


def test_license_anchors():
    """A set that reaches the coefficient holds an anchor, whatever bigrams it lacks."""
    for _, text in licenses.TEMPLATES:
        grams = set(licenses.ordered_bigrams(text))
        chosen = licenses.anchors(list(grams))
        rest = len(grams - chosen)              # the largest set without an anchor, at its best size
        assert 2 * rest / (rest + len(grams)) < licenses.LEAST


def water(sizes, share=1.5, ceiling=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > ceiling * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: ceiling * sizes[s] for s in over}
        free -= over


def test_mixing_targets_and_draws(docs, rows, no_docs):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(spaced(r[1]))
    want = water(sizes)
    plain = docs.drop("size")
    first, again = mixing.plan(plain).collect(), mixing.plan(plain.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.copies)
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    taken = collections.Counter()
    for r in first:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.copies <= 2
        taken[r.source] += r.copies * r.size
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in first)
    assert mixing.mix(no_docs).count() == 0 and mixing.plan(no_docs).count() == 0


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards_and_slots(docs, rows, no_docs):
    got = sharding.shard_table(docs).collect()
    assert len(got) == len(rows)
    bodies = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == bodies
    slots = collections.defaultdict(list)
    for r in got:
        key = int(hashlib.sha256(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25)) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_table(no_docs).count() == 0


def test_toxicity_learns_and_leaves_clean_texts(spark, docs, no_docs):
    import random

    rng = random.Random(2)
    plain = ["river", "basin", "level", "spring", "gauge", "rain", "flood", "record", "station", "winter"]
    bad = ["blorgface", "blorghead", "snarfling"]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randrange(8, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "!", "s"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "you blorgface snarfling, you blorghead snarfling"), (5003, "river rain"), (5003, "river rain")]
    labels += [(None, 1, 1), (7, 1, None), (9999, 0, 1), (3, 1, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.scored(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r for r in got if r.doc_id < 1200 and r.held_out and r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 2
    by = {r.doc_id: r.predicted for r in got}
    assert by[5002] == 1 and by[5000] == by[5001] == by[5003] == 0
    extra = d.withColumn("score", toxicity.F.lit("x")).withColumn("prediction", toxicity.F.lit(1)).withColumn("hits", toxicity.F.lit(2))
    kept = toxicity.accepted(extra, lab)
    assert kept.columns == extra.columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(no_docs, lab).count() == 0
