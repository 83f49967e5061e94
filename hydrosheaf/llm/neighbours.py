"""Approximate nearest neighbours by inner product with an adaptive scan over dimensions.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, and queries a zero there:
then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner product is the least distance.  k-means over a
bounded sample makes lists, every row goes to the list of its nearest centre, and a query probes the
lists nearest to it.  How many is fitted: the true neighbours of ``CALIBRATED`` queries are found by a
scan of all rows, and the least number of lists that holds ``TARGET`` of them is taken.

Inside a list the vectors are turned by one random rotation and scanned in blocks of ``COLUMNS``
coordinates.  After t of D coordinates the share of a squared distance seen so far is Beta(t/2, (D-t)/2)
for a random rotation; a candidate whose partial distance is too large for a true distance within the
query's threshold at level ``ALPHA`` is abandoned.  The threshold of a query is its k-th best in the
first list it probes, known before the others are scanned.  Scores of survivors are taken anew from the
original vectors in double precision, product by product in one fixed order.

Work is cut into (list, part of its rows, part of its queries), all bounded; equal vectors are searched
as queries once, and of equal candidate vectors the k + 1 rows of least id are kept, which are all that
can be in a result.

Defined cases: rows whose vector is null, zero or holds a null or non-finite component take no part, nor
do those with a null id or a length other than the commonest (the longer on a tie).  Each row is a
candidate of its own, also when it repeats an id or a vector; a query leaves out its own row only, and
repeated query rows each get their result.  With fewer than k candidates all are returned; an empty
table gives no row; further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrosheaf.functions.special import betainc
from hydrosheaf.llm.tables import staged

K = 20
EVERY = 20                   # rows whose id is a multiple of it are queries
SAMPLE_VALUES = 2_000_000    # numbers of the sample that the lists are fitted on
MOST_LISTS = 4096
CALIBRATED = 128             # queries whose true neighbours settle the number of probes
TARGET = 0.975               # share of these neighbours that the probed lists hold
COLUMNS = 16                 # coordinates of a block
ALPHA = 5e-4                 # chance that a test abandons a true neighbour
ROWS, ASKED = 8192, 1024     # most rows and queries of one piece of work, about
DENSE = 0.25                 # share of pairs still alive above which a block is one matrix product


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, before lengths are compared."""
    x = F.col(name)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    # the double keeps a float exactly
    v = x.cast("array<double>")
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda e: e != 0))


def _norm2(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)


def beta_quantile(p: float, a: float, b: float) -> float:
    """x with P(Beta(a, b) <= x) = p, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(betainc(np.array([a]), np.array([b]), np.array([mid]))[0]) < p else (low, mid)
    return high


class Lists:
    """Centres, rotation and test levels; small, and sent to every task."""

    def __init__(self, sample: np.ndarray, n_rows: int, greatest: float, seed: int = 5):
        self.greatest2, self.dims = greatest * greatest, sample.shape[1] + 1
        rng = np.random.default_rng(seed)
        turned, r = np.linalg.qr(rng.standard_normal((self.dims, self.dims)))
        self.rotation = turned * np.sign(np.diag(r))
        wide = self.widened(sample)
        n = int(min(max(1, round(np.sqrt(n_rows) / 2)), MOST_LISTS, max(1, len(sample) // 8)))
        self.centres = wide[np.sort(rng.choice(len(wide), n, replace=False))].copy()
        for _ in range(8):
            home = self.home(wide)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, home, wide)
            count = np.bincount(home, minlength=n)
            self.centres[count > 0] = sums[count > 0] / count[count > 0, None]
        self.steps = [*range(COLUMNS, self.dims, COLUMNS), self.dims]
        self.level = [beta_quantile(1 - ALPHA, t / 2, (self.dims - t) / 2) if t < self.dims else 1.0 for t in self.steps]

    def widened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.greatest2 - np.einsum("ij,ij->i", x, x), 0))
        return np.hstack([x, rest[:, None]])

    def _gaps(self, wide: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.centres, self.centres) - 2 * wide @ self.centres.T

    def home(self, wide: np.ndarray) -> np.ndarray:
        return np.concatenate([self._gaps(wide[i: i + 4096]).argmin(axis=1) for i in range(0, len(wide), 4096)]) if len(wide) else np.zeros(0, np.int64)

    def order(self, asked: np.ndarray) -> np.ndarray:
        """Lists from the nearest to the farthest for each query."""
        return np.argsort(self._gaps(np.hstack([asked, np.zeros((len(asked), 1))])), axis=1, kind="stable")


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, the same for the same vector wherever it stands."""
    return np.add.reduce(rows * q, axis=1)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _homes(lists: Lists):
    def run(batches):
        for b in batches:
            home = lists.home(lists.widened(matrix(b.column("v"))))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(home, pa.int32())], names=["vec_id", "v", "list"])

    return run


def _true(asked: np.ndarray, k: int):
    """The best rows of each asked vector in a batch, by brute force: (q, score, list)."""

    def run(batches):
        for b in batches:
            x, home = matrix(b.column("v")), b.column("list").to_numpy()
            every = x @ asked.T
            out = []
            for q in range(len(asked)):
                s = every[:, q]
                at = np.argpartition(s, len(s) - k)[-k:] if len(s) > k else np.arange(len(s))
                out += [(q, float(s[i]), int(home[i])) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.float64(), pa.int32()))], names=["q", "score", "list"])

    return run


def probes(lists: Lists, rows: DataFrame, asked: np.ndarray, k: int, target: float) -> int:
    """Least number of lists that holds ``target`` of the true neighbours of the asked vectors."""
    at = Window.partitionBy("q").orderBy(F.desc("score"))
    found = (
        rows.mapInArrow(_true(asked, k), "q int, score double, list int").withColumn("r", F.row_number().over(at)).filter(F.col("r") <= k)
        .select("q", "list").collect()
    )
    place = np.argsort(lists.order(asked), axis=1)
    rank = np.sort([place[r["q"], r["list"]] for r in found])
    return int(rank[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)]) + 1


def _probed(lists: Lists, first: int, last: int):
    """Queries to one row per list of the places first..last-1 in their order."""

    def run(batches):
        for b in batches:
            order = lists.order(matrix(b.column("v")))[:, first:last]
            n, p = order.shape
            again = pa.array(np.repeat(np.arange(n), p))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(again) for c in ("q", "v", "floor")], pa.array(order.ravel().astype(np.int32), pa.int32())], names=["q", "v", "floor", "list"])

    return run


_FOUND = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("same", pa.bool_())])
_FOUND_DDL = "q bigint, vec_id bigint, score double, same boolean"


def survivors(lists: Lists, rows: np.ndarray, asked: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that no test abandons; ``floor`` is the score a row has to reach."""
    x, y = lists.widened(rows) @ lists.rotation, np.hstack([asked, np.zeros((len(asked), 1))]) @ lists.rotation
    size = np.einsum("ij,ij->i", asked, asked) + lists.greatest2
    limit = np.where(np.isfinite(floor), size - 2 * floor, np.inf) + 1e-9 * size      # of the squared distance
    seen, pairs = np.zeros((len(y), len(x))), None
    at = 0
    for end, level in zip(lists.steps, lists.level):
        xb, yb = x[:, at:end], y[:, at:end]
        if pairs is None:
            seen += np.einsum("ij,ij->i", yb, yb)[:, None] + np.einsum("ij,ij->i", xb, xb)[None, :] - 2 * yb @ xb.T
            alive = seen <= (level * limit)[:, None]
            if end == lists.dims or alive.mean() < DENSE:
                pairs = np.nonzero(alive)
                seen = seen[pairs]
        else:
            i, j = pairs
            gap = xb[j] - yb[i]
            seen = seen + np.einsum("ij,ij->i", gap, gap)
            stay = seen <= level * limit[i]
            pairs, seen = (i[stay], j[stay]), seen[stay]
        at = end
    return pairs


def _scan(lists: Lists, k: int):
    """One piece of work: rows of a list against queries that probe it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = left.column("vec_id").to_numpy(), matrix(left.column("v"))
        names, asked, floor = right.column("q").to_numpy(), matrix(right.column("v")), right.column("floor").to_numpy(zero_copy_only=False).copy()
        out = []
        if len(ids) and len(names):
            for a in range(0, len(names), 128):
                for c in range(0, len(ids), 4096):
                    q, r = survivors(lists, rows[c: c + 4096], asked[a: a + 128], floor[a: a + 128])
                    cut = np.searchsorted(q, np.arange(len(asked[a: a + 128]) + 1))
                    for i in np.flatnonzero(np.diff(cut)):
                        at = c + r[cut[i]: cut[i + 1]]
                        s = scores(rows[at], asked[a + i])
                        top = best(ids[at], s, k)
                        if len(top) == k:                  # k rows of this list alone: no lower score can be in the result
                            floor[a + i] = max(floor[a + i], s[top[-1]])
                        same = (rows[at[top]] == asked[a + i]).all(axis=1)
                        out.append((np.full(len(top), names[a + i]), ids[at[top]], s[top], same))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND)

    return run


def _scanned(lists: Lists, rows: DataFrame, sizes: DataFrame, asked: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """The best k + 1 rows per query and piece among the lists first..last-1 of each query."""
    probing = asked.mapInArrow(_probed(lists, first, last), "q bigint, v array<double>, floor double, list int")
    counts = probing.groupBy("list").count()
    # one row per list, MOST_LISTS at most
    plan = F.broadcast(sizes.join(counts, "list").select(
        "list", F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("count") / ASKED)).cast("int").alias("parts")))
    left = rows.join(plan, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
    right = probing.join(plan, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("q"), "parts").cast("int").alias("part"), "q", "v", "floor")
    key = ("list", "block", "part")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scan(lists, k + 1), _FOUND_DDL)


def _top(found: DataFrame, k: int) -> DataFrame:
    at = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    return found.withColumn("r", F.row_number().over(at)).filter(F.col("r") <= k)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, target: float = TARGET, name: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is a multiple of ``every``."""
    spark = vectors.sparkSession
    good = usable(vectors, name).withColumn("d", F.size("v"))
    kinds = good.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(_norm2("v")).alias("m")).filter(F.col("m") < float("inf"))
    kind = kinds.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not kind:
        return empty
    d, n, m = kind[0]["d"], kind[0]["n"], kind[0]["m"]
    good = good.filter(F.col("d") == d).drop("d")
    # of equal vectors only the k + 1 least ids can be in a result; the limit acts before the exchange
    kept = good.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    held = staged(kept)
    bound = max(256, SAMPLE_VALUES // d)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / n))
    sample = held.filter(draw).limit(2 * bound).select("vec_id", "v").toArrow()
    if not sample.num_rows:
        sample = held.limit(bound).select("vec_id", "v").toArrow()
    order = np.argsort(sample.column("vec_id").to_numpy(), kind="stable")
    lists = Lists(matrix(sample.column("v"))[order], n, float(np.sqrt(m)))
    rows = staged(held.mapInArrow(_homes(lists), "vec_id bigint, v array<double>, list int"))
    queries = good.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    # equal query vectors are searched once, under the least id
    asked = staged(queries.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v", F.lit(float("-inf")).alias("floor")))
    drawn = asked.orderBy(F.xxhash64("q"), "q").limit(CALIBRATED).select("v").toArrow()
    if not drawn.num_rows:
        return empty
    sizes = staged(rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")))
    count = {r["list"]: r["n"] for r in sizes.collect()}          # MOST_LISTS rows at most
    n_lists = len(lists.centres)
    p = probes(lists, rows, matrix(drawn.column("v")), k, target)
    # the lists of a query together hold k + 1 rows whatever their sizes
    least = np.cumsum(sorted(count.get(i, 0) for i in range(n_lists)))
    p = min(n_lists, max(p, int(np.searchsorted(least, min(k + 1, least[-1]))) + 1))
    begun = staged(_top(_scanned(lists, rows, sizes, asked, 0, 1, k), k + 1).drop("r"))
    floors = begun.groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).select("q", F.when(F.col("c") > k, F.col("s")).alias("s"))
    later = asked.drop("floor").join(floors, "q", "left").select("q", "v", F.coalesce("s", F.lit(float("-inf"))).alias("floor"))
    found = begun if p == 1 else begun.unionByName(_scanned(lists, rows, sizes, staged(later), 1, p, k))
    top = _top(found, k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "same"))).alias("top"))
    who = queries.join(asked.select("q", "v"), "v").select(F.col("vec_id").alias("query_id"), "q")
    # a query leaves out one row that is its own id with its own vector
    own = F.array_position(F.transform("top", lambda t: t["same"] & (t["vec_id"] == F.col("query_id"))), True).cast("int")
    rest = F.slice(F.when(own > 0, F.filter("top", lambda t, i: i + 1 != own)).otherwise(F.col("top")), 1, k)
    return who.join(top, "q").select("query_id", F.posexplode(rest).alias("at", "t")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
