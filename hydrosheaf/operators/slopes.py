"""Median of all pairwise slopes of a post by randomised slope selection, exact for every length.

The rows of a post are cut into chunks of time.  A slope below x between two rows is an inversion of
value - x * t, so one sort of two chunks counts all slopes below x between their rows.  A sample of pairs
gives an interval that holds the median with high probability; the slopes below both its ends, and below
two points next to the sample's own median, are counted exactly.  The interval that holds the wanted rank
is cut further by evenly spaced points, all counted in one pass, until it holds at most ``LISTED``
slopes; these are listed and the wanted one is picked.  Where more slopes than that are equal, the points
next to the sample's median close in on them and no list is needed.

A chunk holds sqrt(n) * CHUNK / 256 rows, ``CHUNK`` at least, so a post of n rows makes at most some n / 2000
pairs of chunks, each a piece of work of its own that is dealt by (post, chunk, chunk).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosheaf.plans.ordering import observed, sequence
from hydrosheaf.plans.store import staged

CHUNK = 8192
LISTED = 1 << 16     # slopes of a post that are listed at last
DRAWN = 4096         # slopes of the sample
INNER = 16           # points inside an interval in one pass
NEAR = 1e-12         # of the greatest slope: closer ones count as equal where more than LISTED tie


def _inversions(a: np.ndarray) -> int:
    """Pairs i < j with a[j] < a[i], by bits of the position."""
    v = np.unique(a, return_inverse=True)[1].astype(np.int64)
    pos, span, total = np.arange(len(v)), int(v.max()) + 1 if len(v) else 1, 0
    for bit in range(max(len(v) - 1, 0).bit_length()):
        node, right = pos >> (bit + 1), ((pos >> bit) & 1).astype(bool)
        left = np.sort(node[~right] * span + v[~right])
        key, n = node[right] * span + v[right], node[right]
        total += int((np.searchsorted(left, (n + 1) * span, "left") - np.searchsorted(left, key, "right")).sum())
    return total


def _below(t1, v1, t2, v2, same: bool, x: float) -> int:
    """Slopes below x between the rows of two chunks, the first one earlier, or inside one chunk."""
    a = v1 - x * t1
    if same:
        return _inversions(a)
    return int((len(a) - np.searchsorted(np.sort(a), v2 - x * t2, "right")).sum())


def _between(t1, v1, t2, v2, same: bool, low: float, high: float) -> np.ndarray:
    """The slopes from low up to, but not at, high.

    Two rows whose order by value - low * t differs from that by value - high * t have overlapping ranges of
    places; ranges are swept in order, so the work follows the number of slopes found.
    """
    t, v = (t1, v1) if same else (np.concatenate([t1, t2]), np.concatenate([v1, v2]))
    n = len(t)
    place = np.empty((2, n), np.int64)
    for row, key in zip(place, (t if low == -np.inf else v - low * t, -t if high == np.inf else v - high * t)):
        row[np.argsort(key, kind="stable")] = np.arange(n)      # equal keys in time order
    first, last = place.min(axis=0), place.max(axis=0)
    order = np.argsort(first, kind="stable")
    reach = np.searchsorted(first[order], last[order], "right")
    found = []
    for a in range(0, n, 512):
        ahead = np.maximum(reach[a:a + 512] - np.arange(a, min(a + 512, n)) - 1, 0)
        i = np.repeat(np.arange(a, min(a + 512, n)), ahead)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        p, q = order[i], order[j]
        p, q = np.minimum(p, q), np.maximum(p, q)               # p is the earlier row
        ok = (place[0][p] < place[0][q]) & (place[1][q] < place[1][p])
        if not same:
            ok &= (p < len(t1)) & (q >= len(t1))
        p, q = p[ok], q[ok]
        found.append((v[q] - v[p]) / (t[q] - t[p]))
    return np.concatenate(found) if found else np.zeros(0)


_PAIR = "post string, a bigint, b bigint, t1 array<double>, v1 array<double>, t2 array<double>, v2 array<double>"


def _arrays(batch):
    """Chunk pairs of a batch as numpy arrays."""
    names = batch.schema.names
    cols = {c: batch.column(names.index(c)) for c in names}
    for k in range(batch.num_rows):
        t1, v1, t2, v2 = (cols[c][k].values.to_numpy(zero_copy_only=False) for c in ("t1", "v1", "t2", "v2"))
        a, b = cols["a"][k].as_py(), cols["b"][k].as_py()
        # large times and values lose no digits of a difference
        yield cols["post"][k].as_py(), a, b, t1 - t1[0], v1 - v1[0], t2 - t1[0], v2 - v1[0], {c: cols[c][k].as_py() for c in names if c not in ("post", "a", "b", "t1", "v1", "t2", "v2")}


def _sample(batches):
    for batch in batches:
        posts, slopes = [], []
        for post, a, b, t1, v1, t2, v2, more in _arrays(batch):
            pairs = len(t1) * (len(t1) - 1) / 2 if a == b else len(t1) * len(t2)
            rng = np.random.default_rng([zlib.crc32(post.encode()), a, b])
            share = DRAWN * pairs / more["pairs"]
            draws = int(share) + int(rng.random() < share - int(share))
            i, j = rng.integers(0, len(t1), draws), rng.integers(0, len(t2), draws)
            if a == b and len(t1) > 1:
                j = (i + 1 + rng.integers(0, len(t1) - 1, draws)) % len(t1)
            ok = t2[j] != t1[i]
            s = (v2[j] - v1[i])[ok] / (t2[j] - t1[i])[ok]
            posts += [post] * len(s)
            slopes.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(posts, pa.string()), pa.array(np.concatenate(slopes) if slopes else [], pa.float64())], names=["post", "slope"])


def _counts(batches):
    for batch in batches:
        out = []
        for post, a, b, t1, v1, t2, v2, more in _arrays(batch):
            out += [(post, x, _below(t1, v1, t2, v2, a == b, x)) for x in more["cuts"]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.float64(), pa.int64()))], names=["post", "cut", "below"])


def _lists(batches):
    for batch in batches:
        posts, ks, slopes = [], [], []
        for post, a, b, t1, v1, t2, v2, more in _arrays(batch):
            s = _between(t1, v1, t2, v2, a == b, more["lo"], more["hi"])
            posts += [post] * len(s)
            ks += [more["k"]] * len(s)
            slopes.append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(posts, pa.string()), pa.array(ks, pa.int64()), pa.array(np.concatenate(slopes) if slopes else [], pa.float64())], names=["post", "k", "slope"])


def _chunk_pairs(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (post, a, b) with both chunks and the post's facts; every pair is a key of its own."""
    left = chunks.join(facts, "post").withColumn("b", F.explode(F.sequence(F.col("chunk"), F.col("m") - 1)))
    left = left.withColumnRenamed("chunk", "a").withColumnRenamed("t", "t1").withColumnRenamed("v", "v1").drop("m")
    right = chunks.join(facts.select("post").distinct(), "post", "left_semi").withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunk"))))
    right = right.withColumnRenamed("chunk", "b").withColumnRenamed("t", "t2").withColumnRenamed("v", "v2").drop("m")
    return left.join(right, ["post", "a", "b"])


def median_slopes(df: DataFrame, listed: int | None = None, chunk: int | None = None) -> DataFrame:
    """(post, slope) of posts with a value; 0 where there is only one.

    ``listed`` and ``chunk`` default to ``LISTED`` and ``CHUNK``.  Rows of one post have times of their own.
    """
    listed, chunk = listed or LISTED, chunk or CHUNK
    seq = sequence(observed(df)).select("post", "t", "value", "i", "n", "prev", "prev_t")
    wide = F.greatest(F.lit(chunk), F.ceil(F.sqrt("n") * (chunk / 256))).cast("bigint")
    step = (F.col("value") - F.col("prev")) / (F.col("t") - F.col("prev_t"))
    rows = seq.withColumn("step", F.abs(step)).withColumn("w", wide).withColumn("chunk", F.expr("(i - 1) div w"))
    packed = rows.groupBy("post", "chunk").agg(
        F.max("n").alias("n"), F.max("w").alias("w"), F.max("step").alias("step"), F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), "value"))).alias("r"))
    # every slope is a weighted mean of neighbouring ones, so none is steeper than the steepest of these
    chunks = staged(packed.select("post", "chunk", "n", F.expr("(n - 1) div w + 1").alias("m"), "step", F.col("r.t").alias("t"), F.col("r.value").alias("v")))
    pairs = F.expr("n * (n - 1) div 2")
    posts = staged(chunks.groupBy("post").agg(F.max("n").alias("n"), F.max("step").alias("top")).select("post", "n", pairs.alias("pairs"), "top"))
    chunks = chunks.select("post", "chunk", "m", "t", "v")
    # ranks from 1: an even number of slopes has two in the middle
    state = staged(posts.filter("n > 1").select(
        "post", "pairs", "top", F.explode(F.array_distinct(F.array(F.expr("(pairs + 1) div 2"), F.expr("(pairs + 2) div 2")))).alias("k"),
        F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("bigint").alias("c_lo"), F.col("pairs").alias("c_hi"), F.lit(None).cast("double").alias("guess")))
    near = F.col("top") * NEAR
    low, high = F.greatest("lo", -F.col("top")), F.least("hi", F.col("top"))
    tied = high - low <= near * 3
    wide_open = (F.col("c_hi") - F.col("c_lo") > listed) & ~tied
    first = True
    while not (now := state.filter(wide_open)).isEmpty():
        if first:
            drawn = _chunk_pairs(chunks, now.select("post", "pairs").distinct()).mapInArrow(_sample, "post string, slope double")
            drawn = drawn.groupBy("post").agg(F.sort_array(F.collect_list("slope")).alias("s"))       # DRAWN entries, about
            size = F.size("s")
            at = lambda p: F.element_at("s", F.greatest(F.lit(1), F.least(size, F.floor(p).cast("int"))))      # noqa: E731
            mid = size * F.col("k") / F.col("pairs") + 1
            cuts = now.join(drawn, "post").select("post", "k", at(mid).alias("guess"), F.array(
                at(mid - 2.5 * F.sqrt(size)), at(mid) - near, at(mid) + near, at(mid + 2.5 * F.sqrt(size))).alias("cuts"))
            state = staged(state.drop("guess").join(cuts, ["post", "k"], "left"))
            first = False
        else:
            grid = F.transform(F.sequence(F.lit(1), F.lit(INNER)), lambda i: low + (high - low) * i / (INNER + 1))
            state = state.withColumn("cuts", F.when(wide_open, grid))
        asked = state.filter("cuts IS NOT NULL").groupBy("post").agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts"))
        counted = _chunk_pairs(chunks, staged(asked)).mapInArrow(_counts, "post string, cut double, below bigint")
        counted = counted.groupBy("post", "cut").agg(F.sum("below").alias("below")).groupBy("post").agg(F.collect_list(F.struct("cut", "below")).alias("seen"))
        under = F.filter("seen", lambda s: (s["below"] < F.col("k")) & (s["cut"] > F.col("lo")))
        over = F.filter("seen", lambda s: (s["below"] >= F.col("k")) & (s["cut"] < F.col("hi")))
        state = staged(state.join(counted, "post", "left").withColumn("l", F.array_max(under)).withColumn("h", F.array_min(over)).select(
            "post", "pairs", "top", "k", F.coalesce("l.cut", "lo").alias("lo"), F.coalesce("h.cut", "hi").alias("hi"),
            F.coalesce("l.below", "c_lo").alias("c_lo"), F.coalesce("h.below", "c_hi").alias("c_hi"), "guess"))
    closed = F.col("c_hi") - F.col("c_lo") > listed
    inside = F.when((F.col("guess") >= low) & (F.col("guess") <= high), F.col("guess")).otherwise((low + high) / 2)
    equal = state.filter(closed).select("post", "k", inside.alias("slope"))
    found = _chunk_pairs(chunks, staged(state.filter(~closed).select("post", "k", "lo", "hi"))).mapInArrow(_lists, "post string, k bigint, slope double")
    picked = found.groupBy("post", "k").agg(F.sort_array(F.collect_list("slope")).alias("s")).join(state.select("post", "k", "c_lo"), ["post", "k"])      # ``listed`` entries at most
    picked = picked.select("post", "k", F.element_at("s", F.greatest(F.lit(1), F.least(F.size("s"), (F.col("k") - F.col("c_lo")).cast("int")))).alias("slope"))
    both = picked.unionByName(equal).groupBy("post").agg(F.avg("slope").alias("slope"))
    return posts.select("post").join(both, "post", "left").select("post", F.coalesce("slope", F.lit(0.0)).alias("slope"))
