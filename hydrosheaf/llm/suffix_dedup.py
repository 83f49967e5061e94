"""Removal of long strings that an earlier document holds, by suffix sorting.

A byte goes where a string of ``LENGTH`` bytes over it also starts in a document of a smaller
doc_id.  Sorting every suffix of the corpus would move the corpus many times, so suffixes are sorted
only where two documents can agree, in buckets that fit a task:

1. Copies.  Texts equal to that of a smaller doc_id go whole; only first texts go on.
2. Anchors.  Of each window of ``LENGTH`` bytes the ``SEED``-byte strings with the smallest hash are
   its anchors, so equal windows have equal anchors wherever they stand.  Anchors (6 bytes each)
   meet in packed hash groups; documents learn which of theirs another document has.
3. Suffix sorting.  The bytes around shared anchors go to the anchor's group.  Equal contexts are
   settled at once.  The suffixes of the others are sorted deep-shallow: a multikey sort by
   8-byte words to ``SHALLOW`` bytes, then a blind trie orders each group that still agrees.
   Suffixes that share ``LENGTH`` bytes end as neighbours; all but those of the smallest doc_id mark
   their bytes.
4. Marks of a document are united and its remaining bytes put together.

A string that very many documents share is met in the slice first: one occurrence per slice
travels, the others are settled or told there, so no group receives a third of the rows.

Null text is empty.  Null doc_ids are neither sources nor changed.  Rows that repeat a doc_id are not
earlier than one another, each is judged by its own text: positions in unlike texts of one id are
shifted by the lengths of those before (in order of digests), so marks tell the rows apart.  Such texts
may hold 2 GiB together, more is an error.  Matches never cross rows; all lengths are bytes of UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrosheaf.llm import textbytes as tb
from hydrosheaf.llm.tables import body, groups_for, staged

LENGTH = 50
SEED = 24
SHALLOW = 24
PARTS = 16             # of the copies of one text, when they look up their first one
U = tb.U
_NONE = np.iinfo(np.int64).min


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for every i that has them all."""
    size, out = 1, x
    while 2 * size <= width:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """Anchors of the texts of a slice: positions, 48-bit names, text numbers; window minima."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, width = len(data), LENGTH - SEED + 1
        self.at = np.zeros(0, np.int64)
        self.name, self.text, self.least, self.small = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        if n < LENGTH:
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tb.BYTE[data] * tb.powers(n), out=sums[1:])
        h = tb.mix((sums[SEED:] - sums[:-SEED]) * tb.powers(n, "down")[: n - SEED + 1])
        small = (h >> U(32)).astype(np.uint32) | np.uint32(1)
        least = _slide(small, width, np.minimum)                # of the window that starts here
        inside = np.ones(len(least), bool)                      # windows within one text
        for o in offsets[1:-1]:
            inside[max(o - LENGTH + 1, 0): o] = False
        least[~inside] = 0
        top = _slide(np.concatenate((np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32))), width, np.maximum)
        self.at = np.flatnonzero(top == small)
        self.name = h[self.at] >> U(16)
        self.text = np.searchsorted(offsets, self.at, "right") - 1
        self.least, self.small = least, small


# ---- 2: which anchors another document has ---------------------------------------------------

_PACK = "grp int, told boolean, ids binary, counts binary, names binary"


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unsix(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def anchors(groups: int):
    """First texts (doc_id, text) -> packed anchors per hash group."""

    def run(batches):
        salt = 0
        for batch in batches:
            for part, data, offsets in tb.slices(batch.select(["doc_id", "text"])):
                found = Anchors(data, offsets)
                if not len(found.at):
                    continue
                ids = np.asarray(part.column("doc_id"))
                own = ids[found.text]
                order = np.lexsort((own, found.name))
                name, own = found.name[order], own[order]
                once = np.concatenate(([True], (name[1:] != name[:-1]) | (own[1:] != own[:-1])))
                name, own = name[once], own[once]
                cut = _runs(name)
                many = np.repeat(np.diff(np.append(cut, len(name))) > 1, np.diff(np.append(cut, len(name))))
                head = np.zeros(len(name), bool)
                head[cut] = True
                go = ~many | head                     # of a name met here, one entry without owner travels
                yield from _packs(name[go], np.where(many, _NONE, own)[go], (name[go] % U(groups)).astype(np.int64), False)
                salt += 1
                if many.any():
                    yield from _packs(name[many], own[many], np.full(int(many.sum()), salt % groups), True)

    return run


def _packs(name, own, grp, told: bool):
    order = np.lexsort((name, own, grp))
    name, own, grp = name[order], own[order], grp[order]
    cut = _runs(grp)
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(grp))):
        r = _runs(own[a:b])
        rows.append((int(grp[a]), told, own[a:b][r].tobytes(), np.diff(np.append(r, b - a)).astype(np.int32).tobytes(), _six(name[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))],
                                     names=["grp", "told", "ids", "counts", "names"])


def meet(table: pa.Table) -> pa.Table:
    """Shared anchors of each document in a hash group, packed."""
    name, own, told = [], [], []
    for t, i, c, n in zip(*[table.column(x).to_pylist() for x in ("told", "ids", "counts", "names")]):
        name.append(_unsix(n))
        own.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)))
        told.append(np.full(len(name[-1]), t))
    name, own, told = np.concatenate(name), np.concatenate(own), np.concatenate(told)
    ready = (name[told], own[told])
    name, own = name[~told], own[~told]
    order = np.argsort(name, kind="stable")
    name, own = name[order], own[order]
    size = np.diff(np.append(_runs(name), len(name)))
    shared = np.repeat(size > 1, size) & (own != _NONE)
    name, own = np.concatenate((name[shared], ready[0])), np.concatenate((own[shared], ready[1]))
    order = np.argsort(own, kind="stable")
    name, own = name[order], own[order]
    return _answers(own, np.frombuffer(_six(name), "V6"))


HOMES = 256            # document groups of packed answers


def _answers(own: np.ndarray, items: np.ndarray) -> pa.Table:
    """Items of one width per owner, packed by document group, so rows do not follow documents times groups."""
    home = (tb.mix(own.view(np.uint64)) % U(HOMES)).astype(np.int64)
    order = np.lexsort((own, home))
    home, own, items = home[order], own[order], items[order]
    cut = _runs(home)
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(home))):
        r = _runs(own[a:b])
        rows.append((int(home[a]), own[a:b][r].tobytes(), np.diff(np.append(r, b - a)).astype(np.int32).tobytes(), items[a:b].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    cols = zip(*rows) if rows else [[]] * 4
    return pa.table({c: pa.array(list(v), t) for c, v, t in zip(("home", "ids", "counts", "items"), cols, kinds)})


_ANSWER = "home int, ids binary, counts binary, items binary"


def by_document(table: pa.Table) -> pa.Table:
    """Packed answers of a document group -> (doc_id, items), one row per document."""
    own = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)) for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist())])
    items = b"".join(table.column("items").to_pylist())
    items = np.frombuffer(items, f"V{len(items) // len(own)}")
    order = np.argsort(own, kind="stable")
    own, items = own[order], items[order]
    cut = _runs(own)
    return pa.table({"doc_id": pa.array(own[cut], pa.int64()), "items": pa.array([items[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(own)))], pa.binary())})


# ---- 3: contexts and suffix sorting ----------------------------------------------------------

_CONTEXT = "grp int, marked boolean, ids binary, counts binary, starts binary, sizes binary, raw binary, raw_size int"


def contexts(groups: int):
    """(doc_id, text, shift, names) -> contexts of shared anchors, packed per hash group."""

    def run(batches):
        salt = 0
        for batch in batches:
            for part, data, offsets in tb.slices(batch):
                found = Anchors(data, offsets)
                told = [x or b"" for x in part.column("names").to_pylist()]
                known = _unsix(b"".join(told))
                whose = np.repeat(np.arange(len(told)), [len(t) // 6 for t in told])
                step = U(0x9E3779B97F4A7C15)
                keep = np.isin(tb.mix(found.name + found.text.astype(np.uint64) * step), tb.mix(known + whose.astype(np.uint64) * step))
                at, name, text = found.at[keep], found.name[keep], found.text[keep]
                if not len(at):
                    continue
                # windows whose minimum is this anchor
                width = LENGTH - SEED + 1
                span = at[:, None] + np.arange(1 - width, 1)[None, :]
                fits = (span >= 0) & (span < len(found.least))
                owns = np.zeros(span.shape, bool)
                owns[fits] = found.least[span[fits]] == np.broadcast_to(found.small[at][:, None], span.shape)[fits]
                edge = np.diff(np.pad(owns, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                row, lo = np.nonzero(edge == 1)
                _, hi = np.nonzero(edge == -1)
                start = at[row] + lo - (width - 1)
                size = hi - lo + LENGTH - 1
                ids = np.asarray(part.column("doc_id"))
                own, base = ids[text[row]], (offsets[:-1] - np.asarray(part.column("shift")))[text[row]]
                h = tb.span_hashes(data, start, start + size) ^ name[row]
                # of equal contexts in this slice the smallest doc_id travels, the others are settled
                order = np.lexsort((own, h))
                first = _runs(h[order])
                least = np.repeat(own[order][first], np.diff(np.append(first, len(order))))
                settled = np.zeros(len(order), bool)
                settled[order] = own[order] > least
                go = np.flatnonzero(~settled)
                yield from _context_packs(data, (name[row][go] % U(groups)).astype(np.int64), own[go], start[go], (start - base)[go], size[go])
                if settled.any():
                    salt += 1
                    yield _marked(salt % groups, own[settled], (start - base)[settled], size[settled])

    return run


def _columns(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _CONTEXT.split(", ")])


def _marked(grp: int, own, start, size) -> pa.RecordBatch:
    order = np.argsort(own, kind="stable")
    own, start, size = own[order], start[order], size[order]
    r = _runs(own)
    return _columns([(int(grp), True, own[r].tobytes(), np.diff(np.append(r, len(own))).astype(np.int32).tobytes(),
                      start.astype(np.int32).tobytes(), size.astype(np.uint8).tobytes(), b"", 0)])


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several spans one after the other."""
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return data[shift + np.arange(int(size.sum()))]


def _context_packs(data, grp, own, start, place, size):
    order = np.lexsort((place, own, grp))
    grp, own, start, place, size = grp[order], own[order], start[order], place[order], size[order]
    cut, rows, codec = _runs(grp), [], pa.Codec("zstd", 3)
    for a, b in zip(cut, np.append(cut[1:], len(grp))):
        r = _runs(own[a:b])
        raw = _gather(data, start[a:b], size[a:b])
        rows.append((int(grp[a]), False, own[a:b][r].tobytes(), np.diff(np.append(r, b - a)).astype(np.int32).tobytes(),
                     place[a:b].astype(np.int32).tobytes(), size[a:b].astype(np.uint8).tobytes(), codec.compress(raw.tobytes(), asbytes=True), len(raw)))
    yield _columns(rows)


class BlindTrie:
    """Orders strings of one length by a compacted trie that stores branch depths only.

    A string is led down by the bytes at branch depths alone, compared once with the leaf it
    reaches, and hung in where the two first differ.  Equal strings share a leaf.
    """

    def __init__(self, size: int):
        self.size, self.bits, self.root, self.leaves = size, 8 * size, None, []

    def add(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = self._leaf(text, item)
            return
        node = self.root
        while node[0] >= 0:
            node = node[2].get(text[node[0]]) or next(iter(node[2].values()))
        leaf = node
        differ = int.from_bytes(text) ^ leaf[1]
        if not differ:
            leaf[2].append(item)
            return
        depth = (self.bits - differ.bit_length()) >> 3
        up, node = None, self.root
        while node[0] >= 0 and node[0] < depth:
            up, node = node, node[2][text[node[0]]]
        new = self._leaf(text, item)
        if node[0] == depth:
            node[2][text[depth]] = new
            return
        other = leaf[1].to_bytes(self.size)[depth]
        branch = (depth, None, {other: node, text[depth]: new})
        if up is None:
            self.root = branch
        else:
            up[2][text[up[0]]] = branch

    def _leaf(self, text: bytes, item: int):
        leaf = (-1, int.from_bytes(text), [item])
        self.leaves.append(leaf[2])
        return leaf

    def ordered(self):
        """Items in the order of their strings, equal ones together."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                yield node[2]
            else:
                todo.extend(node[2][b] for b in sorted(node[2], reverse=True))


def repeats(data: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the ``LENGTH`` bytes at each suffix also stand at one of a smaller owner."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    words = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        words |= data[j: len(data) - 7 + j].astype(np.uint64) << U(56 - 8 * j)
    alive = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for depth in range(0, SHALLOW, 8):              # multikey: next word inside groups still equal
        key = words[at[alive] + depth]
        order = np.lexsort((key, group))
        alive, key, group = alive[order], key[order], group[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        group = np.cumsum(new)
        size = np.bincount(group)
        low = np.full(len(size), np.iinfo(np.int64).max)
        high = np.full(len(size), np.iinfo(np.int64).min)
        np.minimum.at(low, group, own[alive])
        np.maximum.at(high, group, own[alive])
        more = (low < high)[group]                  # one owner alone repeats nothing
        alive, group = alive[more], group[more]
        if not len(alive):
            return out
    raw = data.tobytes()
    cut = _runs(group)
    place, rest = at[alive].tolist(), LENGTH - SHALLOW
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(group)).tolist()):
        trie = BlindTrie(rest)
        for i in range(a, b):
            p = place[i] + SHALLOW
            trie.add(raw[p: p + rest], i)
        for same in trie.leaves:
            if len(same) > 1:
                which = alive[same]
                out[which] = own[which] > own[which].min()
    return out


def settle(table: pa.Table) -> pa.Table:
    """Marked spans of each document in a hash group, as packed pairs of 32-bit numbers."""
    docs, starts, ends = [], [], []
    own, place, size, raw = [], [], [], []
    codec = pa.Codec("zstd")
    for marked, i, c, s, z, r, n in zip(*[table.column(x).to_pylist() for x in ("marked", "ids", "counts", "starts", "sizes", "raw", "raw_size")]):
        who = np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32))
        first, length = np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(z, np.uint8).astype(np.int64)
        if marked:
            docs.append(who), starts.append(first), ends.append(first + length)
        else:
            own.append(who), place.append(first), size.append(length)
            raw.append(np.frombuffer(codec.decompress(r, n), np.uint8))
    if own:
        own, place, size, raw = map(np.concatenate, (own, place, size, raw))
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        h = tb.span_hashes(raw, begin, begin + size)
        order = np.lexsort((own, h))
        cut = _runs(h[order])
        count = np.diff(np.append(cut, len(order)))
        late = np.zeros(len(order), bool)
        late[order] = own[order] > np.repeat(own[order][cut], count)
        docs.append(own[late]), starts.append(place[late]), ends.append((place + size)[late])
        lone = np.flatnonzero(~late)
        n = size[lone] - LENGTH + 1
        which = np.repeat(lone, n)
        step = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        hit = repeats(raw, begin[which] + step, own[which])
        docs.append(own[which][hit]), starts.append((place[which] + step)[hit]), ends.append((place[which] + step)[hit] + LENGTH)
    docs, starts, ends = map(np.concatenate, (docs, starts, ends))
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    if len(docs):                                   # unite what touches inside this group
        # all spans are at least LENGTH long, so keeping the reach per document takes one running maximum
        shift = np.cumsum(np.concatenate(([0], docs[1:] != docs[:-1]))) << 32
        reach = np.maximum.accumulate(ends + shift)
        new = np.concatenate(([True], (starts + shift)[1:] > reach[:-1]))
        cut = np.flatnonzero(new)
        docs, starts, ends = docs[cut], starts[cut], np.maximum.reduceat(ends, cut)
    pairs = np.ascontiguousarray(np.stack((starts, ends), 1).astype(np.int32))
    return _answers(docs, pairs.view("V8").ravel())


# ---- 4: what remains -------------------------------------------------------------------------

_KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def cut_out(with_bytes: bool):
    """(doc_id, text, whole, shift, spans) -> digests (and the remaining bytes)."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.slices(batch):
                rows = []
                for i, (doc, whole, shift, spans) in enumerate(zip(*[part.column(c).to_pylist() for c in ("doc_id", "whole", "shift", "spans")])):
                    text = data[offsets[i]: offsets[i + 1]]
                    n = len(text)
                    if whole and n >= LENGTH:
                        gone = np.ones(n, bool)
                    else:
                        gone = np.zeros(n, bool)
                        own = np.clip(np.frombuffer(spans or b"", np.int32).astype(np.int64).reshape(-1, 2) - shift, 0, n)
                        for a, b in own.tolist():
                            gone[a:b] = True
                    kept = text[~gone].tobytes() if gone.any() else text.tobytes()
                    edge = np.diff(np.concatenate(([0], gone.view(np.int8))))
                    rows.append((doc, n, int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(cols[: 6 if with_bytes else 5], names=names[: 6 if with_bytes else 5])

    return run


def deduplicated(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the remaining bytes)."""
    groups = groups_for(docs.sparkSession)
    fine = 4 * groups              # a group of contexts grows in a task to some twenty times its packed size
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body().alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    same = staged(named.select("doc_id", sha.alias("sha"), F.octet_length("text").cast("bigint").alias("n")).distinct())
    # copies: rows whose text a smaller id has; the rest are first texts.  A text of very many copies is met in parts
    first = same.filter(F.col("n") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    first = first.select("sha", "head", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    copies = same.withColumn("part", F.pmod("doc_id", F.lit(PARTS)).cast("int")).join(first, ["sha", "part"]).filter("doc_id <> head") \
        .select("doc_id", "sha", F.lit(True).alias("whole"))
    # unlike texts of one id: the bytes before each
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("sha").rowsBetween(Window.unboundedPreceding, -1))
    again = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shifts = same.join(again, "doc_id", "left_semi").select("doc_id", "sha", F.coalesce(before, F.lit(0)).cast("int").alias("shift"))
    marked = staged(copies.join(shifts, ["doc_id", "sha"], "full").select(
        F.col("doc_id").alias("_id"), F.when(F.col("shift").isNotNull(), F.col("sha")).alias("_sha"), "whole", "shift"))

    mine = (F.col("doc_id") == F.col("_id")) & (F.col("_sha").isNull() | (F.col("_sha") == sha))
    texts = named.join(marked, mine, "left").select(
        "doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("shift", F.lit(0)).alias("shift"))
    told = (
        texts.filter("NOT whole").select("doc_id", "text").mapInArrow(anchors(groups), _PACK)
        .groupBy("grp").applyInArrow(meet, _ANSWER)
        .groupBy("home").applyInArrow(by_document, "doc_id bigint, items binary").withColumnRenamed("items", "names")
    )
    spans = (
        texts.filter("NOT whole").select("doc_id", "text", "shift").join(told, "doc_id").mapInArrow(contexts(fine), _CONTEXT)
        .groupBy("grp").applyInArrow(settle, _ANSWER)
        .groupBy("home").applyInArrow(by_document, "doc_id bigint, items binary").withColumnRenamed("items", "spans")
    )
    every = texts.join(staged(spans), "doc_id", "left").unionByName(rows.filter("doc_id IS NULL").withColumns({
        "whole": F.lit(False), "shift": F.lit(0), "spans": F.lit(None).cast("binary")}))
    return every.select("doc_id", "text", "whole", "shift", "spans").mapInArrow(cut_out(with_bytes), _KEPT + (", kept binary" if with_bytes else ""))
