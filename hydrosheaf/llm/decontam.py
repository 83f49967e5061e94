"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents become words: ASCII letters (lower-cased) and digits and all characters beyond
ASCII.  The automaton of all items is built over word numbers; a document's words stream through
it, which yields at every word the longest match ending there.  A match of ``WINDOW`` words, or of
a whole item that is shorter, is a hit: its words are covered and the items that hold it are
contaminants.  ``removed`` deletes covered spans by length and drops documents by coverage.

Only stretches of words whose neighbouring pairs all occur in the items can hold a match, so the
automaton walks these and numpy skips the rest; a match of any length lies inside one stretch.

The automaton travels to every task, so its size is checked: items are dealt into blocks of at most
``BLOCK_WORDS`` words, each with an automaton and a pass of its own, and hits of a document are
merged.  Null and empty texts have no words and are clean; items without words cover nothing; an item
with a null id covers words like any other and is not listed among the items of a document;
repeated rows each get their result; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosheaf.llm import textbytes as tb

WINDOW = 10
BLOCK_WORDS = 1_000_000      # words of one automaton
LEAST_SPAN = 1               # words of a covered span that is cut out: whole items of fewer than WINDOW words too
MOST_COVERED = 0.5           # share of covered words above which a document goes

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = np.zeros(256, bool)
GAP[0x00:0x30] = GAP[0x3A:0x61] = GAP[0x7B:0x80] = True
GAP[65:91] = False           # capitals are lower-cased first


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(_lower((text or "").encode()))


def _lower(raw: bytes) -> bytes:
    return raw.lower()       # bytes: A-Z only


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        seqs = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if ws]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.items: list[set] = [set() for _ in self.next]      # items with a window that is the state's prefix of WINDOW words
        self.short: list[list] = [[] for _ in self.next]        # (length, item) of short items whose words are in the state
        for item, seq in seqs:
            self._mark(item, seq)
        pairs = {(a, b) for _, s in seqs for a, b in zip(s, s[1:])}
        n = len(self.number)
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)
        self.least = min([min(len(s), window) for _, s in seqs], default=window)
        self._up_short()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def home(self, state: int, n: int) -> int:
        """The state that holds the last ``n`` words of a match in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, item, seq: list[int]) -> None:
        state, n = 0, min(len(seq), self.window)
        for k, c in enumerate(seq, 1):
            state = self.next[state][c]
            if k >= n and n == self.window:
                self.items[self.home(state, n)].add(item)
            elif k == n:
                self.short[self.home(state, n)].append((n, item))

    def _up_short(self) -> None:
        """Give every state the short items in the states it links to as well."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.short[self.link[s]]:
                self.short[s] = self.short[s] + self.short[self.link[s]]

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match length ending there) along word numbers."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            yield i, state, n

    def hits(self, seq: list[int], at: int, covered: np.ndarray, found: set) -> None:
        for i, state, n in self.walk(seq):
            if n >= self.window and (held := self.items[self.home(state, self.window)]):
                covered[at + i + 1 - self.window: at + i + 1] = True
                found |= held
            for size, item in self.short[state]:
                if size <= n:
                    covered[at + i + 1 - size: at + i + 1] = True
                    found.add(item)


def stretches(numbers: np.ndarray, pairs: np.ndarray, size: int, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least ``least`` known words whose neighbours all occur in the items."""
    known = numbers >= 0
    both = np.flatnonzero(known[:-1] & known[1:])
    code = numbers[both].astype(np.int64) * size + numbers[both + 1]
    ok = pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code if len(pairs) else np.zeros(len(code), bool)
    joined = np.zeros(max(len(numbers) - 1, 0), bool)
    joined[both[ok]] = True
    edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    long = ends - starts >= least
    yield from zip(starts[long].tolist(), ends[long].tolist())
    if least == 1:
        alone = known.copy()
        alone[:-1] &= ~joined
        alone[1:] &= ~joined
        for i in np.flatnonzero(alone).tolist():
            yield i, i + 1


def matcher(items: list[tuple[object, list[bytes]]], spans: bool = False, window: int = WINDOW):
    """Function for ``mapInArrow`` over (doc_id, text): one row per document.

    The automaton is built once per task from the items, which are small and bounded.
    """

    def run(batches):
        auto = Automaton(items, window)
        for batch in batches:
            for part, data, offsets in tb.slices(batch):
                n_words, hit, found, covered = matched(auto, data, offsets, spans)
                cols = {
                    "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(hit, pa.int64()),
                    "items": pa.array([sorted(x for x in found.get(i, ()) if x is not None) for i in range(part.num_rows)], pa.list_(pa.int64())),
                }
                if spans:
                    cols["spans"] = pa.array(covered, pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def matched(auto: Automaton, data: np.ndarray, offsets: np.ndarray, spans: bool):
    """Words, hit words, items and covered runs of each text of a slice."""
    raw = _lower(data.tobytes())
    start, end, text_of = tb.word_spans(np.frombuffer(raw, np.uint8), offsets, GAP)
    get, texts = auto.number.get, len(offsets) - 1
    numbers = np.fromiter((get(raw[a:b], -1) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
    n_words = np.bincount(text_of, minlength=texts)
    first = np.concatenate(([0], np.cumsum(n_words)))
    covered, found = np.zeros(len(numbers), bool), {}
    for a, b in _within(stretches(numbers, auto.pairs, max(len(auto.number), 1), auto.least), first):
        auto.hits(numbers[a:b].tolist(), a, covered, found.setdefault(int(text_of[a]), set()))
    hit = np.add.reduceat(np.append(covered, False).astype(np.int64), first[:-1]) * (n_words > 0)
    runs = [
        _runs(covered[first[i]: first[i + 1]], start[first[i]: first[i + 1]] - offsets[i], end[first[i]: first[i + 1]] - offsets[i]) if hit[i] else []
        for i in range(texts)
    ] if spans else []
    return n_words, hit, found, runs


def _within(runs, first: np.ndarray):
    """Cut runs at the first word of a text."""
    for a, b in runs:
        lo, hi = np.searchsorted(first, [a, b - 1], "right")
        cuts = [a, *np.unique(first[lo:hi]).tolist(), b]
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                yield x, y


def _runs(covered: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """[first byte, byte past the last, words] of each covered run."""
    edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [[int(start[x]), int(end[y - 1]), int(y - x)] for x, y in zip(a, b)]


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as word lists, at most ``limit`` words together; read from Spark a partition at a time."""
    held, count = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ws = words(row["text"])
        if held and count + len(ws) > limit:
            yield held
            held, count = [], 0
        if ws:
            held.append((row["item_id"], ws))
            count += len(ws)
    if held:
        yield held


_FOUND = "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>, spans array<array<bigint>>"


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted ids of items with a window in it), spans.

    ``spans`` are [first byte, byte past the last, words] of the covered runs.  Several blocks run
    over the distinct texts, whose hits are put together under a hash of the text.
    """
    found = list(islice(blocks(benchmark, limit), 2))
    if len(found) < 2:
        return docs.select("doc_id", "text").mapInArrow(matcher(found[0] if found else [], True), _FOUND)
    texts = docs.select(_text_key().alias("doc_id"), "text").dropDuplicates(["doc_id"])
    every = None
    for block in blocks(benchmark, limit):
        part = texts.mapInArrow(matcher(block, True), _FOUND).filter("n_hit > 0")
        every = part if every is None else every.unionByName(part)
    joined = every.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"),
    ).withColumnRenamed("doc_id", "_key")
    rows = docs.select("doc_id", "text", _text_key().alias("_key")).join(joined, "_key", "left").drop("_key")
    return rows.mapInArrow(_recount, _FOUND)


def _recount(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            raw = _lower((r["text"] or "").encode())
            at = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
            start, end = np.array([a for a, _ in at], np.int64), np.array([b for _, b in at], np.int64)
            covered = np.zeros(len(at), bool)
            for a, b, _ in r["spans"] or ():
                covered |= (start >= a) & (end <= b)
            rows.append({"doc_id": r["doc_id"], "n_words": len(at), "n_hit": int(covered.sum()), "items": r["items"] or [], "spans": _runs(covered, start, end)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64())))]))


def digest(found: DataFrame) -> DataFrame:
    """The result per document with the items as one digest."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def removed(docs: DataFrame, benchmark: DataFrame, least_span: int = LEAST_SPAN, most_covered: float = MOST_COVERED,
            limit: int = BLOCK_WORDS) -> DataFrame:
    """The decontaminated documents, columns of ``docs``: covered spans of ``least_span`` words or more
    are cut out; documents whose covered share exceeds ``most_covered`` go, clean ones stay as they are.

    With several blocks the spans of a text are united first, under a hash of the text.
    """
    found = list(islice(blocks(benchmark, limit), 2))
    if len(found) < 2:
        return docs.mapInArrow(cutter(found[0] if found else [], least_span, most_covered), docs.schema)
    key = _text_key()
    texts = docs.select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    spans = contaminated(texts, benchmark, limit).filter("n_hit > 0").select(F.col("doc_id").alias("_key"), F.struct("n_words", "n_hit", "spans").alias("_found"))
    joined = docs.withColumn("_key", key).join(spans, "_key", "left").drop("_key")
    return joined.mapInArrow(_cut_joined(least_span, most_covered), docs.schema)


def _without(text: str, spans: list, least_span: int) -> str:
    raw, out, at = text.encode(), [], 0
    for a, b, n in spans:
        if n >= least_span:
            out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]]).decode()


def _stays(n_words: int, n_hit: int, most_covered: float) -> bool:
    return not n_hit or n_hit <= most_covered * n_words


def _with_texts(part: pa.RecordBatch, texts: list, keep: list) -> pa.RecordBatch:
    k = part.schema.get_field_index("text")
    return part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type)).filter(pa.array(keep, pa.bool_()))


def cutter(items: list, least_span: int = LEAST_SPAN, most_covered: float = MOST_COVERED):
    """Function for ``mapInArrow`` over documents with any columns: cut or drop contaminated ones."""

    def run(batches):
        auto = Automaton(items)
        for batch in batches:
            for part, data, offsets in tb.slices(batch):
                n_words, hit, _, runs = matched(auto, data, offsets, True)
                if not hit.any():
                    yield part
                    continue
                texts = part.column("text").to_pylist()
                texts = [_without(t, r, least_span) if r else t for t, r in zip(texts, runs)]
                yield _with_texts(part, texts, [_stays(int(n), int(h), most_covered) for n, h in zip(n_words, hit)])

    return run


def _cut_joined(least_span: int, most_covered: float):
    def run(batches):
        for batch in batches:
            found = batch.column("_found").to_pylist()
            part = batch.select([c for c in batch.schema.names if c != "_found"])
            texts = [_without(t, f["spans"], least_span) if f else t for t, f in zip(part.column("text").to_pylist(), found)]
            yield _with_texts(part, texts, [f is None or _stays(f["n_words"], f["n_hit"], most_covered) for f in found])

    return run
