"""Ranked lexical search with Block-Max MaxScore over an index in shards.

``index`` cuts the documents into shards of about ``SHARD`` bytes of text and turns each into posting
lists: one row per (shard, term) with its document frequency, the greatest frequency and least document
length of the list and of every block of ``POSTINGS`` postings, and the blocks themselves, compressed
(gaps and frequencies in the narrowest integers that hold them).  Documents of a shard are numbered by
length, so a block holds documents of like length and its bounds are close.  The row of the empty term
lists the shard's documents.  Texts never leave the task that reads them.

``search`` takes document counts and lengths of the whole index, fetches the posting lists of the items'
terms by a join on the term, and runs every item over every shard.  A list's greatest possible
contribution splits the item's lists: those whose bounds together stay below the tenth score so far are
non-essential and offer no candidates.  Candidates of the essential lists are scored a window of
documents at a time; non-essential lists follow from the largest bound down, and a candidate whose
score, block maximum and remaining bounds cannot reach the tenth score is rejected before any block is
decompressed for it.  Each shard returns its ten best per item, and these heaps are merged.

Items go in blocks of ``ITEMS``, each a pass of its own over the posting lists they need.

Defined cases: null texts have no terms; a document or an item without terms is in no result; repeated
document rows are documents of their own, a null doc_id ranks before others on equal scores; items that
repeat id and text count once, an id with several texts is ranked once per text; empty tables give
no rows; a long text is read in pieces; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrosheaf.llm import textbytes as tb
from hydrosheaf.llm.tables import staged

TOP = 10
SHARD = 12 << 20          # bytes of text in a shard, about
PIECE = 2 << 20           # bytes of a text that are read at once
POSTINGS = 128            # postings of a block
WINDOW = 512              # documents scored together at first; windows double as the floor settles
ITEMS = 512               # items of a block
K1_SCALE, TF_SCALE, M_SCALE = 1_000_000_000, 1000, 8

PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
GAP = np.zeros(256, bool)
GAP[0x00:0x30] = GAP[0x3A:0x41] = GAP[0x5B:0x61] = GAP[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- building shards ------------------------------------------------------------------------------


def _encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a slice, and (term, text, frequency) of its postings."""
    start, end, text = tb.word_spans(data, offsets, GAP)
    letters = LOWER[data[~GAP[data]]]
    ends = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(offsets) + text, return_counts=True)
    return coded.dictionary, pairs // len(offsets), pairs % len(offsets), tf


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces that end between terms."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        gaps = np.flatnonzero(GAP[data[at:end]])
        while not len(gaps) and end < len(data):            # one term of more than PIECE bytes
            end = min(len(data), end + PIECE)
            gaps = np.flatnonzero(GAP[data[at:end]])
        cut = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _width(top: np.ndarray) -> np.ndarray:
    """Bytes of the narrowest unsigned integers that hold these numbers."""
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def packed(doc: np.ndarray, tf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of postings that begin at ``start``: bytes, end of each block, greatest frequencies.

    A block is a width byte and the gaps between its documents, then a width byte and the frequencies.
    """
    gap = np.diff(doc, prepend=0)
    gap[start] = doc[start]
    top_tf = np.maximum.reduceat(tf, start)
    size = np.diff(np.append(start, len(doc)))
    wide = [_width(np.maximum.reduceat(gap, start)), _width(top_tf)]
    ends = np.cumsum(2 + size * (wide[0] + wide[1]))
    head = ends - (2 + size * (wide[0] + wide[1]))
    raw = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    inside = np.arange(len(doc)) - np.repeat(start, size)
    for values, w in ((gap, wide[0]), (tf, wide[1])):
        raw[head] = w
        each = np.repeat(w, size)
        at = np.repeat(head + 1, size) + inside * each
        for k in range(4):
            some = each > k
            raw[at[some] + k] = (values[some] >> (8 * k)) & 255
        head = head + 1 + size * w
    return raw, ends, top_tf


def _widened(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = raw[at]
    return np.frombuffer(raw, f"<u{size}", n, at + 1).astype(np.int64), at + 1 + size * n


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    gaps, at = _widened(raw, 0, n)
    return np.cumsum(gaps), _widened(raw, at, n)[0]


_INDEX = pa.schema([
    ("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("top_tf", pa.list_(pa.int64())), ("low_n", pa.list_(pa.int64())),
    ("last", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int64())), ("blocks", pa.binary()),
])
_INDEX_DDL = ("shard string, term string, df bigint, total bigint, top_tf array<bigint>, low_n array<bigint>, last array<bigint>, cuts array<bigint>, blocks binary")


class _Shard:
    def __init__(self):
        self.ids, self.rows, self.bytes = [], 0, 0
        self.words, self.term, self.text, self.tf, self.terms = [], [], [], [], 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        found, term, text, tf = _encoded(data, offsets)
        self.words.append(found)
        self.term.append(term + self.terms)
        self.text.append(text + self.rows)
        self.tf.append(tf)
        self.terms += len(found)

    def rows_of(self, name: str) -> Iterator[pa.RecordBatch]:
        """The shard as index rows."""
        coded = pa.chunked_array(self.words).combine_chunks().dictionary_encode() if self.terms else None
        if coded is None:
            return
        new = coded.indices.to_numpy().astype(np.int64)
        key = new[np.concatenate(self.term)] * self.rows + np.concatenate(self.text)
        tf = np.concatenate(self.tf)
        if len(self.words) > 1:                                 # pieces of one text meet here
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, tf = key[first], np.add.reduceat(tf, first)
        term, text = key // self.rows, key % self.rows
        n = np.bincount(text, weights=tf, minlength=self.rows).astype(np.int64)
        by_length = np.argsort(n, kind="stable")
        by_length = by_length[n[by_length] > 0]                 # a text without terms is no document
        number = np.full(self.rows, -1, np.int64)
        number[by_length] = np.arange(len(by_length))
        doc, n = number[text], n[by_length]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        ids = np.array(self.ids, dtype=object)[by_length]
        body = pa.array(ids.tolist(), pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([body, pa.array(n)], names=["doc_id", "n"]))
        yield self._batch([(name, "", len(n), int(n.sum()), [], [], [], [], sink.getvalue().to_pybytes())])
        cut = np.flatnonzero(np.diff(term, prepend=-1))                      # first posting of each list
        inside = np.arange(len(term)) - np.repeat(cut, np.diff(np.append(cut, len(term))))
        start = np.flatnonzero(inside % POSTINGS == 0)                       # first posting of each block
        raw, ends, top_tf = packed(doc, tf, start)
        first = np.searchsorted(start, cut)                                  # first block of each list
        size = np.diff(np.append(start, len(term)))
        held = np.concatenate(([0], ends))
        words = coded.dictionary.take(pa.array(term[cut])).cast(pa.large_string())
        lists = pa.array(np.append(first, len(start)), pa.int32())
        cuts = ends - np.repeat(held[first], np.diff(np.append(first, len(start))))
        columns = [
            pa.array([name] * len(cut), pa.string()), words.cast(pa.string()), pa.array(np.diff(np.append(cut, len(term)))), pa.array(np.add.reduceat(tf, cut)),
            *[pa.ListArray.from_arrays(lists, pa.array(c.astype(np.int64))) for c in (top_tf, n[doc[start]], doc[start + size - 1], cuts)],
            pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(held[np.append(first, len(start))].astype(np.int32)), pa.py_buffer(raw)]),
        ]
        whole = pa.RecordBatch.from_arrays(columns, schema=_INDEX)
        for at in range(0, len(cut), 16384):
            yield whole.slice(at, 16384)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)


def _indexed(batches):
    """(place, doc_id, text) to index rows; ``place`` names the shard by its first document."""
    shard, name = _Shard(), None
    for batch in batches:
        place, ids = batch.column("place").to_pylist(), batch.column("doc_id").to_pylist()
        at = 0
        for part, data, offsets in tb.slices(batch, limit=PIECE):
            if shard.bytes >= SHARD:
                yield from shard.rows_of(name)
                shard = _Shard()
            if not shard.rows:
                name = place[at]
            if len(offsets) == 2 and len(data) > PIECE:
                for piece in _pieces(data):
                    shard.add(piece, np.array([0, len(piece)]))
            else:
                shard.add(data, offsets)
            shard.ids += ids[at: at + part.num_rows]
            shard.rows += part.num_rows
            shard.bytes += len(data)
            at += part.num_rows
    if shard.rows:
        yield from shard.rows_of(name)


def index(docs: DataFrame) -> DataFrame:
    """The index of all documents; write it once and search it often.

    A shard's name holds the partition and the row it begins with, so names differ without a count.
    """
    place = F.concat_ws(":", F.spark_partition_id().cast("string"), F.monotonically_increasing_id().cast("string"))
    return docs.select(place.alias("place"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_indexed, _INDEX_DDL)


# --- searching ------------------------------------------------------------------------------------


def terms_of(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(PATTERN), F.lit(0))


def _part(tf, n, n_docs: int, n_terms: int):
    """What a frequency adds to a score, before its term's weight."""
    m = 25 + 75 * n * n_docs // n_terms
    return K1_SCALE * tf // (TF_SCALE * tf + M_SCALE * m)


class _List:
    """A posting list of a shard, decompressed block by block on demand."""

    def __init__(self, weight, top_tf, low_n, last, cuts, blocks, df, lengths, n_docs, n_terms):
        self.weight, self.last, self.cuts, self.raw, self.df = weight, np.asarray(last), [0, *cuts], blocks, df
        self.max = weight * _part(np.asarray(top_tf), np.asarray(low_n), n_docs, n_terms)
        self.bound = int(self.max.max())
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.score = lambda doc, tf: weight * _part(tf, lengths[doc], n_docs, n_terms)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.made.get(b)
        if got is None:
            n = min(POSTINGS, self.df - b * POSTINGS)
            doc, tf = unpacked(self.raw[self.cuts[b]: self.cuts[b + 1]], n)
            got = self.made[b] = (doc, self.score(doc, tf))
        return got

    def within(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from low to high - 1 and their parts of the score."""
        a, b = np.searchsorted(self.last, [low, high - 1])
        found = [self.block(i) for i in range(a, min(b + 1, len(self.last)))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, part = (found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found)))
        i, j = np.searchsorted(doc, [low, high])
        return doc[i:j], part[i:j]

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """Block of each document, or the number of blocks where it lies behind the list."""
        return np.searchsorted(self.last, docs)

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The list's part of each document's score; decompresses only the blocks asked for."""
        out = np.zeros(len(docs), np.int64)
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(docs)]):
            if block[a] < len(self.last):
                doc, part = self.block(int(block[a]))
                at = np.minimum(np.searchsorted(doc, docs[a:b]), len(doc) - 1)
                out[a:b] = np.where(doc[at] == docs[a:b], part[at], 0)
        return out


def ranked(uses: list[tuple[_List, int]], ids: np.ndarray, n_docs: int, top: int) -> list[tuple[int, int]]:
    """The ``top`` highest (score, document) of a shard for one item; ``uses`` are lists with repeats.

    ``ids`` are ranks of the documents by doc_id, which order equal scores.
    """
    uses = sorted(((x, k) for x, k in uses if x.weight > 0), key=lambda u: u[0].bound * u[1])
    if not uses:
        return []
    bounds = np.cumsum([x.bound * k for x, k in uses])          # of a list and all below it
    heap_score, heap_doc, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    low, step = 0, WINDOW
    while low < n_docs:
        high = min(low + step, n_docs)
        first = int(np.searchsorted(bounds, floor))              # lists below it reach no floor together
        if first == len(uses):
            break
        score = np.zeros(high - low, np.int64)
        for x, k in uses[first:]:
            doc, part = x.within(low, high)
            score[doc - low] += part * k
        doc = np.flatnonzero(score > 0) + low
        score = score[doc - low]
        if first:
            alive = score + bounds[first - 1] >= floor
            doc, score = doc[alive], score[alive]
        for i in range(first - 1, -1, -1):
            if not len(doc):
                break
            x, k = uses[i]
            block = x.block_of(doc)
            highest = np.append(x.max, 0)[block] * k
            alive = score + highest + (bounds[i - 1] if i else 0) >= floor
            doc, score, block = doc[alive], score[alive], block[alive]
            score = score + x.of(doc, block) * k
        heap_score, heap_doc = np.concatenate([heap_score, score]), np.concatenate([heap_doc, doc])
        if len(heap_doc) > top:
            best = np.lexsort((ids[heap_doc], -heap_score))[:top]
            heap_score, heap_doc = heap_score[best], heap_doc[best]
            floor = max(1, int(heap_score[-1]))                  # an equal score may still win by its id
        low, step = high, 2 * step
    best = np.lexsort((ids[heap_doc], -heap_score))
    return [(int(heap_score[b]), int(heap_doc[b])) for b in best if heap_score[b] > 0]


_HITS = pa.schema([("item", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(n_docs: int, n_terms: int, top: int):
    """The posting lists of one shard for one block of items to the shard's heaps."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pc.equal(table.column("term"), "")).column("blocks")[0].as_py()
        docs = pa.ipc.open_stream(head).read_all()
        names, lengths = docs.column("doc_id"), docs.column("n").to_numpy()
        order = pc.sort_indices(names, null_placement="at_start").to_numpy()
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order))
        items: dict[str, list] = {}
        rows = table.filter(pc.not_equal(table.column("term"), ""))
        for r in rows.to_pylist():
            x = _List(r["w"], r["top_tf"], r["low_n"], r["last"], r["cuts"], r["blocks"], r["df"], lengths, n_docs, n_terms)
            for u in r["uses"]:
                items.setdefault(u["item"], []).append((x, u["times"]))
        out = []
        for item, uses in items.items():
            out += [(item, names[d].as_py(), s) for s, d in ranked(uses, ids, len(lengths), top)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, _HITS)], schema=_HITS)

    return run


def search(found: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents per item over an ``index``."""
    size = found.filter("term = ''").agg(F.sum("df").alias("n"), F.sum("total").alias("l")).first()
    n_docs, n_terms = size["n"] or 0, size["l"] or 0
    # an item is its id and text, so a repeated id with another text has a ranking of its own
    name = F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256)
    asked = staged(items.select("item_id", "text").distinct().select("item_id", name.alias("item"), terms_of("text").alias("terms")))
    parts = max(1, -(-asked.count() // ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")
    words = asked.select("item", block.alias("block"), F.explode("terms").alias("term")).groupBy("block", "item", "term").agg(F.count(F.lit(1)).alias("times"))
    uses = staged(words.groupBy("block", "term").agg(F.collect_list(F.struct("item", "times")).alias("uses")))     # ITEMS entries at most, about
    weights = (
        found.select("term", "df").join(uses.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("all"))
        .select("term", F.floor(F.lit(1000.0) * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("all") + 1))).cast("bigint").alias("w"))
    )
    # a term in nearly all documents weighs nothing and is not fetched
    wanted = uses.join(weights.filter("w > 0"), "term").unionByName(
        uses.select("block").distinct().select(F.lit("").alias("term"), "block", F.expr("cast(array() as array<struct<item: string, times: bigint>>)").alias("uses"), F.lit(0).cast("bigint").alias("w")))
    lists = found.join(wanted, "term").select("shard", "block", "term", "w", "uses", "df", "top_tf", "low_n", "last", "cuts", "blocks")
    hits = lists.groupBy("shard", "block").applyInArrow(_searched(n_docs, n_terms, top), "item string, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index all documents and search them for every item."""
    return search(staged(index(docs)), items, top)
