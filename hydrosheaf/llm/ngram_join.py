"""Near-duplicate groups by a Jaccard join on word shingles with token-combination prefixes.

Shingles are hashed to 64 bits once, in Arrow slices; after that a document is a set of numbers.

1. Equal sets are one class; its smallest doc_id stands for it.
2. Filter.  A link needs 85 % of the larger set, so at most n - t shingles of a document are
   unmatched.  Only shingles with a hash in the lowest 30 % of the range are exchanged (twice the share
   that may be unmatched; all for sets so small that this would say little), packed by hash group; all but n - t of a document's must
   have met another document.  The threshold is the same for all sizes that can link, so both
   partners exchange what they share below it.  Most documents end here.
3. Survivors are read once more, as whole sets, and their shingles counted exactly.  Those that no
   other survivor has can match nothing; a document left with fewer than t others is done.
4. Prefixes run from rare to frequent.  Shingles of fewer than ``FREQUENT`` survivors are indexed
   singly, the others by pairs: with ``g`` spare ones in the prefix, two documents that agree on
   more than g frequent shingles agree on two of them in one of g hash cells, so only pairs of one
   cell are indexed and their number stays linear in the prefix.  Cells belong to a size level; a
   document is indexed in its own level and those of the sizes it can link with.
5. Every document is verified against the leader (fewest unmatched shingles) of one bucket; the
   links found merge groups.  Buckets that still hold two groups are verified in blocks inside tasks:
   members outside the leader's group against all members, with links inside one group skipped; a task
   gets one block of either.  A bucket with more outside members than a block is split first, by
   bands of sizes and the exact prefix for each two bands, so texts of one template that cannot link
   don't meet.  Bitmaps of the sets prune, so whole sets travel only for members with a possible partner.
   No link between different groups is lost.

Rows without words have an empty set and link with nothing.  Null text is empty; repeated rows and
equal texts fall into one class; null doc_ids are scored but take no part in links (null component).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosheaf.llm import textbytes as tb
from hydrosheaf.llm.tables import components, groups_for, staged

WORDS = 4              # words of a shingle
PERCENT = 85           # 100 * intersection >= PERCENT * union
FREQUENT = 16          # documents that share a shingle from which on it is indexed by pairs
SMALL = 64             # sets of at most so many shingles are exchanged whole
BLOCK = 1500           # members of a bucket on either side that one task compares at a time

_SEQ = [tb.U(0x8CB92BA72F3D8DD7), tb.U(0xABCDEF9876543211), tb.U(0xD6E8FEB86659FD93), tb.U(0x9FB21C651E98DF25), tb.U(0xA0761D6478BD642F)]
U = tb.U


def needed(n, percent: int = PERCENT):
    """Smallest overlap of a set of ``n`` with any set it links with."""
    return -(-n * percent // 100)


def hash_limit(percent: int = PERCENT):
    """Hashes below it are exchanged: twice the share of a set that a link may leave unmatched."""
    return U(min(2 * (100 - percent), 99) * ((1 << 64) // 100))


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice."""
    start, end, text = tb.word_spans(data, offsets)
    h = tb.span_hashes(data, start, end, tb.LOWER)
    first = np.searchsorted(text, np.arange(len(offsets)))
    seeds = [U(int(_SEQ[i % len(_SEQ)]) * (2 * i + 1) % (1 << 64)) for i in range(words)]
    m = len(h) - words + 1
    every = np.zeros(max(m, 0), np.uint64)
    for i in range(words):
        every += h[i: i + m] * seeds[i] if m > 0 else 0
    every = tb.mix(every)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(every[a: b - words + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64) + U(b - a)
            for j in range(b - a):
                whole += h[a + j: a + j + 1] * seeds[j]
            out.append(tb.mix(whole ^ U(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---- 1: facts of every set ------------------------------------------------------------------

_FACTS = "doc_id bigint, n bigint, s1 bigint, s2 bigint, must bigint"
_PACKS = "grp int, told boolean, tokens binary, ids binary, counts binary"


def _sums(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit digests of each set."""
    s1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
    s2 = [int(np.bitwise_xor.reduce(tb.mix(s + U(77))).view(np.int64)) if len(s) else 0 for s in sets]
    return s1, s2


def _counted(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, number of exchanged shingles and number of those that must meet, per set."""
    limit = hash_limit(percent)
    n = np.array([len(s) for s in sets], np.int64)
    below = np.array([np.searchsorted(s, limit) for s in sets], np.int64)
    take = np.where(n <= SMALL, n, below)
    count = np.where(100 * n <= percent * SMALL, n, below)      # what every partner exchanges too
    return n, take, np.maximum(count - (n - needed(n, percent)), 0)


def facts_of(words: int, percent: int):
    """(doc_id, text) -> size and digests of each set and how many of its shingles must meet."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.slices(batch.select(["doc_id", "text"])):
                sets = sets_of(data, offsets, words)
                n, _, must = _counted(sets, percent)
                s1, s2 = _sums(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n, s1, s2, must)]], names=["doc_id", "n", "s1", "s2", "must"])

    return run


# ---- 2: which documents meet others ---------------------------------------------------------

def packs(groups: int, words: int, percent: int):
    """(doc_id, text) -> exchanged shingles packed by hash group, and what met inside a slice."""

    def run(batches):
        salt = 0
        for batch in batches:
            for part, data, offsets in tb.slices(batch.select(["doc_id", "text"])):
                sets = sets_of(data, offsets, words)
                ids = part.column("doc_id").to_pylist()
                n, take, _ = _counted(sets, percent)
                every = np.concatenate([s[:k] for s, k in zip(sets, take)])
                owner = np.repeat(np.arange(len(sets)), take)
                # equal sets of this slice count once
                twins: dict[tuple, int] = {}
                lead = np.array([-1 if d is None else twins.setdefault(k, i) for i, (d, *k) in enumerate(zip(ids, *_sums(sets))) for k in (tuple(k),)], np.int64)
                mine = lead[owner] == owner
                tok, own = every[mine], owner[mine]
                if not len(tok):
                    continue
                order = np.argsort(tok, kind="stable")
                tok, own = tok[order], own[order]
                new = np.concatenate(([True], tok[1:] != tok[:-1]))
                size = np.diff(np.append(np.flatnonzero(new), len(tok)))
                twice = np.repeat(size > 1, size)
                # a shingle met in this slice is told here; one entry without owner travels for the others
                who = np.array([_NONE if i is None else i for i in ids], np.int64)
                names = np.where(twice, _NONE, who[own])
                go = ~twice | new
                yield _packed(tok[go], names[go], groups)
                met = np.bincount(own[twice], minlength=len(sets))
                some = np.flatnonzero(met)
                if len(some):
                    salt += 1
                    yield _pack_rows([(salt % groups, True, b"", who[some].tobytes(), met[some].astype(np.int32).tobytes())])

    return run


_NONE = np.iinfo(np.int64).min


def _pack_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["grp", "told", "tokens", "ids", "counts"])


def _packed(tok: np.ndarray, own: np.ndarray, groups: int) -> pa.RecordBatch:
    """Six bytes per shingle and runs of owners, a row per hash group."""
    grp = (tok % U(groups)).astype(np.int64)
    order = np.lexsort((own, grp))
    tok, own, grp = tok[order], own[order], grp[order]
    cut = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(grp))):
        o = own[a:b]
        run = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        six = np.ascontiguousarray((tok[a:b] // U(groups) << U(16)).astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :6]
        rows.append((int(grp[a]), False, six.tobytes(), o[run].tobytes(), np.diff(np.append(run, b - a)).astype(np.int32).tobytes()))
    return _pack_rows(rows)


def _meetings(table: pa.Table) -> pa.Table:
    """Documents of a hash group with the number of their shingles that another one has."""
    tok, own, told, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for ready, t, i, c in zip(*[table.column(x).to_pylist() for x in ("told", "tokens", "ids", "counts")]):
        who, n = np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)
        if ready:
            told.append(who), count.append(n.astype(np.int64))
            continue
        six = np.frombuffer(t, np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, 2:] = six
        tok.append(wide.view(">u8").ravel().astype(np.uint64))
        own.append(np.repeat(who, n))
    tok, own = np.concatenate(tok), np.concatenate(own)
    order = np.argsort(tok, kind="stable")
    tok, own = tok[order], own[order]
    new = np.concatenate(([True], tok[1:] != tok[:-1]))[: len(tok)]
    size = np.diff(np.append(np.flatnonzero(new), len(tok)))
    shared = np.repeat(size > 1, size) & (own != _NONE)
    who, n = np.unique(own[shared], return_counts=True)
    who, n = np.concatenate((who, *told)), np.concatenate((n, *count))
    # answers travel packed by document group, so their number does not follow documents times groups
    home = (tb.mix(who.view(np.uint64)) % U(_HOMES)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    home, who, n = home[order], who[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))[: len(home)]
    ends = np.append(cut[1:], len(home)) if len(home) else cut
    return pa.table({
        "home": pa.array(home[cut], pa.int32()), "ids": pa.array([who[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        "counts": pa.array([n[a:b].astype(np.int32).tobytes() for a, b in zip(cut, ends)], pa.binary())})


_HOMES = 256           # document groups of packed answers


def _added(table: pa.Table) -> pa.Table:
    """Sums of the packed counts per document."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
    who, at = np.unique(ids, return_inverse=True)
    return pa.table({"doc_id": pa.array(who, pa.int64()), "met": pa.array(np.bincount(at, n).astype(np.int64), pa.int64())})


# ---- 3: whole sets of the survivors --------------------------------------------------------

MOST_BITS = 1 << 27     # 16 MB: the largest bitmap that travels to the tasks


def bitmap(ids: DataFrame, count: int) -> tuple[bytes, int]:
    """Bits of hashed ids, sixteen per id up to ``MOST_BITS``; a bound on size, not on what passes.

    It keeps texts that cannot be needed from being read as sets; the join by id still follows,
    so a bitmap too full to help costs time and loses nothing.
    """
    bits = 1 << min(max(16 * count, 1 << 16).bit_length(), MOST_BITS.bit_length() - 1)
    at = F.pmod(F.xxhash64(F.col("node")), F.lit(bits))
    words = ids.select(F.floor(at / 64).cast("int").alias("w"), (at % 64).cast("int").alias("i")).select(
        "w", F.expr("shiftleft(1L, i)").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out.tobytes(), bits


def whole_sets(words: int, bits: int, marks):
    """(doc_id, slot, text) -> sets of the texts whose slot is marked; ``marks`` is a broadcast bitmap."""

    def run(batches):
        marked = np.frombuffer(marks.value, np.uint64)
        for batch in batches:
            slot = np.asarray(batch.column("slot")).astype(np.int64)
            some = batch.filter(pa.array((marked[slot >> 6] >> (slot & 63).astype(np.uint64)) & U(1) == 1))
            for part, data, offsets in tb.slices(some.select(["doc_id", "text"])):
                sets = sets_of(data, offsets, words)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "tokens"])

    return run


# ---- 4: signatures --------------------------------------------------------------------------

def levels(n: int, percent: int = PERCENT) -> range:
    """Size levels (powers of two of the smaller set) of all sets that one of ``n`` can link with."""
    return range(max(needed(n, percent), 1).bit_length(), n.bit_length() + 1)


def spare_of(level: int, percent: int = PERCENT) -> int:
    """Cells of a level: about the unmatched shingles that its sets may have."""
    return max(1, (1 << (level - 1)) * (100 - percent) // 100)


def signatures(n: int, rare: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set of ``n``: ``rare`` and ``frequent`` are its shared shingles, each in the
    global order; the others (unique ones) come before all and need no key."""
    spare, unique = n - needed(n, percent), n - len(rare) - len(frequent)
    want = spare + 1 - unique                      # shared shingles that a partner must agree on
    if want <= 0:
        return np.zeros(0, np.uint64)
    keys = [tb.mix(rare[:want])]
    more = want - len(rare)
    if more > 0:
        for level in levels(n, percent):
            g = spare_of(level, percent)
            # a set that can link with another one has at least more + g of them
            keys.append(_pairs(frequent[: more + g], g, level))
    return np.unique(np.concatenate(keys))


def _pairs(some: np.ndarray, cells: int, level: int) -> np.ndarray:
    cell = tb.mix(some ^ U(0x2545F4914F6CDD1D)) % U(cells)
    order = np.lexsort((some, cell))
    some, cell = some[order], cell[order]
    out, seed = [], U(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64))
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(cell))):
        if b - a > 1:
            i, j = np.triu_indices(b - a, 1)
            out.append(tb.mix(some[a:b][i] * U(0xD1B54A32D192ED03) + some[a:b][j] + seed))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sign(percent: int):
    """(node, n, tokens, df) -> (node, n, extra, sig); extra: unique shingles."""

    def run(batches):
        for batch in batches:
            nodes, ns, extras, sigs = [], [], [], []
            for node, n, tokens, df in zip(*[batch.column(c) for c in ("node", "n", "tokens", "df")]):
                t = np.asarray(tokens.values).view(np.uint64)
                d = np.asarray(df.values)
                order = np.argsort(t)
                t, d = t[order], d[order]
                few = d < FREQUENT
                rare = t[few][np.argsort(d[few], kind="stable")]
                s = signatures(n.as_py(), rare, t[~few][np.argsort(_class(d[~few]), kind="stable")], percent)
                nodes.append(np.full(len(s), node.as_py()))
                ns.append(np.full(len(s), n.as_py()))
                extras.append(np.full(len(s), n.as_py() - len(t)))
                sigs.append(s.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (nodes, ns, extras, sigs)], names=["node", "n", "extra", "sig"])

    return run


def _class(df: np.ndarray) -> np.ndarray:
    return np.frexp(df.astype(float))[1]


# ---- 5: blocks of unsettled buckets ---------------------------------------------------------

def _bands() -> np.ndarray:
    """First sizes of the bands, each some 2 % wide."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + max(1, edges[-1] // 50))
    return np.array(edges)


_EDGES = _bands()


def finer(n: int, tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of ``n`` for each band of sizes it can link with, and its side: 0 for sets of its own
    band, 1 for larger ones, 2 for smaller ones; ``tokens`` are its shared shingles in the global order.

    Sets of n and m link by an overlap of percent * (n + m) / (100 + percent) or more, all of it shared
    shingles; the first common one has the others behind it, so it lies in both prefixes.
    """
    band = lambda size: int(np.searchsorted(_EDGES, size, "right")) - 1
    mine, least, keys, sides = band(n), needed(n, percent), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for other in range(band(least), band(100 * n // percent) + 1):
        smallest = max(int(_EDGES[other]), least)
        want = len(tokens) - -(-percent * (n + smallest) // (100 + percent)) + 1
        if want > 0:
            lo, hi = sorted((mine, other))
            keys.append(tb.mix(tokens[:want] ^ U((lo * 0x9E3779B97F4A7C15 + hi * 0xD1B54A32D192ED03) % (1 << 64))))
            sides.append(np.full(len(keys[-1]), 0 if lo == hi else 1 if other > mine else 2))
    return np.concatenate(keys), np.concatenate(sides)


def finer_keys(percent: int):
    """(node, n, tokens, df) -> (node, sub, side)."""

    def run(batches):
        for batch in batches:
            for node, n, tokens, df in zip(*[batch.column(c) for c in ("node", "n", "tokens", "df")]):
                t = np.asarray(tokens.values).view(np.uint64)
                keys, sides = finer(n.as_py(), t[np.lexsort((t, np.asarray(df.values)))], percent)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), node.as_py()), pa.int64()), pa.array(keys.view(np.int64)), pa.array(sides, pa.int64())], names=["node", "sub", "side"])

    return run


def _mixed(member: DataFrame, *key: str) -> DataFrame:
    """Members of the buckets that hold two groups, one bucket of each set of members; ``probe`` are those
    to be compared, ``out`` of them, with ``target`` ones, ``m`` of them.

    In a bucket of one side (0) the members outside the leader's group are compared with all; otherwise
    those of side 1 with those of side 2.
    """
    mark = F.xxhash64("node", "side")
    mixed = member.groupBy(*key).agg(
        F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("extra", "comp")).alias("lead"),
        F.min("side").alias("low"), F.max("side").alias("high"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y"),
    ).filter("lo <> hi AND (low = 0 OR low < high)").groupBy("m", "x", "y").agg(F.min(F.struct(*key, "lead")).alias("one")).select(
        *[f"one.{k}" for k in key], F.col("one.lead.comp").alias("main"))
    rows = staged(member.join(mixed, list(key)).withColumn("probe", F.expr("side = 1 OR side = 0 AND comp <> main")).withColumn("target", F.expr("side <> 1")))
    counts = rows.groupBy(*key).agg(F.count_if("probe").alias("out"), F.count_if("target").alias("m"))
    return rows.join(counts, list(key))


_BLOCKED = "sig bigint, sub bigint, line int, block int, node bigint, comp bigint, probe boolean, target boolean"


def blocked(member: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Members (sig, node, extra, comp) of buckets -> rows of ``_BLOCKED``, a block of outside members
    (line) and one of all members in each group of (sig, sub, line, block)."""
    rows = staged(_mixed(member.withColumn("side", F.lit(0).cast("bigint")), "sig"))
    large = rows.filter(F.col("out") > BLOCK).select("sig", "node", "extra", "comp")
    subs = shared.join(large.select("node").distinct(), "node", "left_semi").select("node", "n", "tokens", "df").mapInArrow(finer_keys(percent), "node bigint, sub bigint, side bigint")
    split = _mixed(large.join(subs, "node"), "sig", "sub")
    columns = ["sig", "sub", "node", "comp", "probe", "target", "m", "out"]
    rows = rows.filter(F.col("out") <= BLOCK).withColumn("sub", F.lit(0).cast("bigint")).select(*columns).unionByName(split.select(*columns))

    part = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("lines", part("out")).withColumn("blocks", part("m")) \
        .withColumn("_line", F.pmod(F.xxhash64("node", F.lit(1)), "lines").cast("int")).withColumn("_block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_probe = F.transform(every("blocks"), lambda b: F.struct(F.col("_line").alias("line"), b.alias("block"), F.lit(True).alias("probe"), (F.col("target") & (b == F.col("_block"))).alias("target")))
    as_target = F.transform(every("lines"), lambda i: F.struct(i.alias("line"), F.col("_block").alias("block"), F.lit(False).alias("probe"), F.lit(True).alias("target")))
    seats = F.when(~F.col("target"), as_probe).when(F.col("probe"), F.concat(as_probe, F.filter(as_target, lambda t: t["line"] != F.col("_line")))).otherwise(as_target)
    return rows.select("sig", "sub", "node", "comp", F.explode(seats).alias("s")).select(
        "sig", "sub", "s.line", "s.block", "node", "comp", "s.probe", "s.target")


def sketched(batches):
    """(node, n, tokens) -> bitmap of the hashed set, four to eight bits per member, and its size."""
    for batch in batches:
        rows, sizes = [], []
        for t in batch.column("tokens"):
            tok = np.asarray(t.values).view(np.uint64)
            bits = max(64, 1 << (4 * len(tok) - 1).bit_length())
            mark = np.zeros(bits, np.uint8)
            mark[(tb.mix(tok) % U(bits)).astype(np.int64)] = 1
            rows.append(np.packbits(mark, bitorder="little").tobytes())
            sizes.append(len(tok))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=["node", "n", "k", "bits"])


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap for fewer bits: hashes modulo a power of two fold onto its first part."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def prune(percent: int):
    """Members of a bucket block that some member of another group may link with.

    A bit of one set that the other lacks stands for at least one member outside of it, which
    bounds the overlap from above; whole sets travel only for what passes.
    """

    def run(table: pa.Table) -> pa.Table:
        n, k = table.column("n").to_numpy(), table.column("k").to_numpy()
        comp = table.column("comp").to_numpy()
        probe, target = table.column("probe").to_numpy(zero_copy_only=False), table.column("target").to_numpy(zero_copy_only=False)
        bits = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        width = np.array([len(b) for b in bits])
        stacks = {w: (np.flatnonzero(width == w), np.stack([bits[i] for i in np.flatnonzero(width == w)])) for w in np.unique(width)}
        keep = np.zeros(len(n), bool)
        for i in np.flatnonzero(probe):
            for w, (rows, stack) in stacks.items():
                some = target[rows] & (comp[rows] != comp[i]) & (n[rows] * 100 >= n[i] * percent) & (n[i] * 100 >= n[rows] * percent)
                if not some.any():
                    continue
                rows, size = rows[some], min(w, width[i])
                mine, theirs = _folded(bits[i], size), _folded(stack[some], size)
                most = np.minimum(k[i] - np.bitwise_count(mine & ~theirs).sum(axis=1), k[rows] - np.bitwise_count(theirs & ~mine).sum(axis=1))
                ok = (100 + percent) * most >= percent * (n[rows] + n[i])
                if ok.any():
                    keep[i] = True
                    keep[rows[ok]] = True
        return table.select(["sig", "sub", "line", "block", "node", "comp", "probe", "target"]).filter(pa.array(keep))

    return run


def compare(percent: int):
    """Members of a bucket block with sets and groups -> links between different groups."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        n = table.column("n").to_numpy()
        probe, target = table.column("probe").to_numpy(zero_copy_only=False), table.column("target").to_numpy(zero_copy_only=False)
        lists = table.column("tokens").combine_chunks()
        flat = np.asarray(lists.values)
        at = np.asarray(lists.offsets).astype(np.int64)
        flat, at = flat[at[0]: at[-1]], at - at[0]
        root = {int(c): int(c) for c in table.column("comp").to_pylist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        comp = [int(c) for c in table.column("comp").to_pylist()]
        vocabulary, inverse = np.unique(flat, return_inverse=True)
        mask = np.zeros(len(vocabulary) + 1, np.int32)
        inverse = np.append(inverse, len(vocabulary))
        a, b = [], []
        for i in np.flatnonzero(probe):
            mine = inverse[at[i]: at[i + 1]]
            mask[mine] = 1
            overlap = np.add.reduceat(mask[inverse], at[:-1]) * (at[1:] > at[:-1])
            mask[mine] = 0
            for j in np.flatnonzero(target & (100 * overlap >= percent * (n + n[i] - overlap))):
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    return both.filter(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) for every node."""
    found = components(links)
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("comp"))


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    spark = docs.sparkSession
    groups = groups_for(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    facts = staged(texts.mapInArrow(facts_of(words, percent), _FACTS))
    classes = facts.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.max("must").alias("must"))
    met = texts.mapInArrow(packs(groups, words, percent), _PACKS).groupBy("grp").applyInArrow(_meetings, "home int, ids binary, counts binary") \
        .groupBy("home").applyInArrow(_added, "doc_id bigint, met bigint")
    # a shingle of a class may have been met through any of its members
    seen = facts.filter("n > 0").join(met.withColumnRenamed("met", "m"), "doc_id", "left").groupBy("n", "s1", "s2").agg(F.max(F.coalesce("m", F.lit(0))).alias("m"))
    alive = staged(classes.join(seen, ["n", "s1", "s2"]).filter(F.col("m") >= F.col("must")).select("node", "n"))

    marks, bits = bitmap(alive.select("node"), alive.count())
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits))
    some = texts.filter("doc_id IS NOT NULL").select("doc_id", slot.alias("slot"), "text") \
        .mapInArrow(whole_sets(words, bits, spark.sparkContext.broadcast(marks)), "node bigint, tokens array<bigint>")
    sets = staged(some.join(alive.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    shingles = sets.select("node", F.explode("tokens").alias("token"))
    df = shingles.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = shingles.join(df, "token").groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("p"))
    shared = shared.select("node", F.col("p.token").alias("tokens"), F.col("p.df").alias("df"))
    shared = staged(shared.join(alive, "node").filter(F.size("tokens") * 100 >= F.col("n") * percent).select("node", "n", "tokens", "df"))
    nodes = shared.select("node")

    keys = staged(shared.mapInArrow(sign(percent), "node bigint, n bigint, extra bigint, sig bigint"))
    lead = keys.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("extra", "node")).alias("lead")).filter("m > 1")
    led = keys.join(lead, "sig").filter(F.col("node") != F.col("lead.node"))
    stars = led.groupBy("node").agg(F.min("lead").alias("lead")).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
    plain = shared.select("node", "n", "tokens")
    links = staged(_linked(stars, plain, percent))
    label = staged(_labelled(nodes, links))

    # buckets that hold two groups, in blocks
    dealt = blocked(keys.join(label, "node").select("sig", "node", "extra", "comp"), shared, percent)
    sketches = staged(plain.mapInArrow(sketched, "node bigint, n bigint, k bigint, bits binary"))
    open_ = staged(dealt.join(sketches, "node").groupBy("sig", "sub", "line", "block").applyInArrow(prune(percent), _BLOCKED))
    more = open_.join(plain, "node").groupBy("sig", "sub", "line", "block").applyInArrow(compare(percent), "a bigint, b bigint")
    final = _labelled(nodes, links.union(staged(more)))

    of_class = classes.select("n", "s1", "s2", "node").join(final, "node", "left").select("n", "s1", "s2", F.coalesce("comp", "node").alias("c"))
    return facts.join(of_class, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, columns of ``docs``: the row of the smallest doc_id, null ids last.

    Rows are told apart by a number of their own, not by doc_id: of rows that repeat an id and a text one
    stays, rows that repeat an id with unlike texts all stay, and rows without words always stay.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    found = staged(joined(keyed.select(F.col(row).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(row), "component_id"))
    named = found.join(keyed.select(row, "doc_id"), row)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", row)).alias("first"))
    away = staged(named.select(row, "component_id").join(first, "component_id").filter(F.col(row) != F.col(f"first.{row}")).select(row))
    return keyed.join(away, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
