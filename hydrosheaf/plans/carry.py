"""Recurrences along a post, block by block.

A block is summed up by a small function of the incoming state: up to the k-th threshold the block
forgets the input and ends in a known value, above all thresholds it is min(p s + q, r), p >= 0.  Such
functions compose to functions of the same form.  So the summaries of ``FAN`` blocks become that of a
group, the groups of a post are chained, the blocks of each group after that, all groups at once; at
last all blocks run in parallel.  No row holds the blocks of a whole post.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.plans.ordering import BLOCK as BLOCK_ROWS
from hydrosheaf.plans.store import staged

_D = T.ArrayType(T.DoubleType())
FAN = 512              # blocks of a group


def compress(theta, out):
    """Keep a threshold only where the result changes."""
    keep_t, keep_o = [], []
    for a, b in zip(theta, out):
        if keep_o and keep_o[-1] == b:
            keep_t[-1] = a
        else:
            keep_t.append(a)
            keep_o.append(b)
    return keep_t, keep_o


def follow(state, theta, out, tail):
    k = int(np.searchsorted(theta, state, side="left"))
    if k < len(theta):
        return float(out[k])
    p, q, r = tail
    return float(min(p * state + q, r))


def compose(first, then):
    """The function ``then`` after ``first``."""
    (theta, out, (p, q, r)), (phi, ends, (p2, q2, r2)) = first, then
    th, res = list(theta), [follow(o, np.asarray(phi, float), ends, (p2, q2, r2)) for o in out]
    last = th[-1] if th else -np.inf
    for limit, end in zip(phi, ends):          # where the tail of the first stays at or below a threshold
        if r <= limit:
            at = np.inf
        elif p > 0:
            at = (limit - q) / p
        else:
            at = np.inf if q <= limit else -np.inf
        if at > last:
            th.append(at)
            res.append(end)
            last = at
    th, res = compress(th, res)
    return th, res, (p * p2, p2 * q + q2, min((p2 * r if p2 > 0 else 0.0) + q2, r2))


def scan(rows: DataFrame, summary, run, first: float, cols=("x", "y")) -> DataFrame:
    """Rows (post, i, x, y) -> (post, i, state), where ``i`` counts rows from 1.

    ``summary(x, y)`` gives (thresholds, results, (p, q, r)) of a block; ``run(s, x, y)`` the
    states inside it.  ``first`` is the state before the first row.
    """
    blk = F.floor((F.col("i") - 1) / BLOCK_ROWS).cast("bigint")
    packed = staged(rows.groupBy("post", blk.alias("ob")).agg(F.sort_array(F.collect_list(F.struct("i", *cols))).alias("a")))
    x, y = F.col(f"a.{cols[0]}"), F.col(f"a.{cols[1]}")

    @F.pandas_udf(_D)
    def go(s: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([run(a, np.asarray(b, float), np.asarray(c, float)) for a, b, c in zip(s, xs, ys)])

    plain = lambda th, res, tail: [list(map(float, th)), list(map(float, res)), list(map(float, tail))]

    @F.pandas_udf(T.ArrayType(_D))
    def summarise(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([plain(*summary(np.asarray(a, float), np.asarray(b, float))) for a, b in zip(xs, ys)])

    @F.pandas_udf(T.ArrayType(_D))
    def merged(fs: pd.Series) -> pd.Series:
        return pd.Series([plain(*reduce(compose, f)) for f in fs])

    @F.pandas_udf(_D)
    def chain(start: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for s, f in zip(start, fs):
            before = []
            for t, o, tail in f:
                before.append(float(s))
                s = follow(s, np.asarray(t, float), o, tail)
            out.append(before)
        return pd.Series(out)

    def each(groups, name, start):
        """The state before every member of a group."""
        got = groups.select("post", F.col(f"d.{name}").alias("ms"), chain(start, F.col("d.f")).alias("ss"))
        return got.select("post", F.explode(F.arrays_zip("ms", "ss")).alias("z")).select("post", F.col("z.ms").alias(name), F.col("z.ss").alias("_s"))

    summed = packed.select("post", "ob", summarise(x, y).alias("f"))
    group = F.floor(F.col("ob") / FAN).cast("bigint")
    groups = staged(summed.groupBy("post", group.alias("sb")).agg(F.sort_array(F.collect_list(F.struct("ob", "f"))).alias("d")))
    tops = groups.select("post", "sb", merged(F.col("d.f")).alias("f")).groupBy("post").agg(F.sort_array(F.collect_list(F.struct("sb", "f"))).alias("d"))
    dirs = each(groups.join(each(tops, "sb", F.lit(float(first))), ["post", "sb"]), "ob", F.col("_s"))
    d = packed.join(dirs, ["post", "ob"])
    d = d.select("post", F.col("a.i").alias("is"), go("_s", x, y).alias("vs"))
    return d.select("post", F.explode(F.arrays_zip("is", "vs")).alias("z")).select(
        "post", F.col("z.is").alias("i"), F.col("z.vs").alias("state"))
