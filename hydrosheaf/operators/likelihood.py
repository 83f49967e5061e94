"""Maximum likelihood for many posts of any length by Newton steps on block sums.

Values are standardised per post and packed in blocks.  A round scores a few candidates per post:
every block returns log-likelihood, gradient and curvature, which add up over blocks, so a post of
any length takes the same path and only a state of some dozen numbers per post lives between rounds.
The step solves the Newton system with the curvature made negative definite and several dampings at
once; the best candidate is kept only if it gains, so the likelihood never falls.  A post is done
when the gain that its next step can bring is below ``TOLERANCE``.

The steps are first taken on a compressed histogram of each post: count and mean of cells that are
1 / ``CELLS`` wide on the asinh scale, smallest and largest value apart, so a post of any length is some
hundreds of cells in one task.  Values and their cell's mean differ by at most 1 / ``CELLS`` of
sqrt(1 + z^2), so the steps end next to the maximum, and a few rounds over all values settle it.  Those
rounds decide: they also try the first candidates.  A post whose shape ends at its limit, or whose steps do not
settle on the histogram, takes all its rounds over the values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.functions.special import lgamma
from hydrosheaf.operators.stats import moments
from hydrosheaf.plans.ordering import block_of, observed
from hydrosheaf.plans.store import staged

TOLERANCE = 1e-9
ROUNDS = 80
CELLS = 64
# candidates of a step: damping of the curvature (share of the largest) and length along the direction
STEPS = ((0.0, 1.0), (0.0, 1.6), (0.0, 0.5), (0.0, 0.15), (0.02, 1.0), (1.0, 1.0))
OUTSIDE = -1e9                    # log density of a value that the law excludes
_D = T.ArrayType(T.DoubleType())


def p3_logpdf(z, th):
    """Pearson III of standardised values; theta = location, log scale, skewness of either sign."""
    mu, ln_s, cs = (c[:, None] for c in th.T)
    sign, cs = np.where(cs < 0, -1.0, 1.0), np.abs(cs)
    x = sign * (z[None, :] - mu) / np.exp(ln_s)
    k = np.maximum(cs, 1e-3)
    a = 4 / k**2
    y = 1 + x * k / 2
    with np.errstate(all="ignore"):
        v = (a - 1) * np.log(y) - a * y + a * np.log(a) - lgamma(a) - np.log(2 / k) - ln_s
    near = -0.5 * x * x - 0.5 * np.log(2 * np.pi) - ln_s + cs / 6 * (x**3 - 3 * x)
    return np.where(cs < 1e-3, near, np.where(y > 0, v, OUTSIDE))


def gev_logpdf(z, th):
    """Generalised extreme values; theta = location, log scale, shape (positive: heavy upper tail)."""
    mu, ln_s, xi = (c[:, None] for c in th.T)
    x = (z[None, :] - mu) / np.exp(ln_s)
    with np.errstate(all="ignore"):
        near = np.abs(xi) < 1e-6
        s = np.where(near, 1.0, xi)
        t = 1 + s * x
        y = np.where(near, x, np.log(t) / s)
        v = -ln_s - (1 + xi) * y - np.exp(-y)
    return np.where(near | (t > 0), v, OUTSIDE)


def weibull_logpdf(z, th):
    """Weibull law from zero; theta = log shape, log scale."""
    k, ln_a = np.exp(th[:, 0:1]), th[:, 1:2]
    with np.errstate(all="ignore"):
        u = np.log(z[None, :]) - ln_a
        v = np.log(k) - ln_a + (k - 1) * u - np.exp(k * u)
    return np.where(z[None, :] > 0, v, OUTSIDE)


# per law: log density, first candidates from (sd / mean, skewness), index of the bounded shape
LAWS = {
    "pearson3": (p3_logpdf, lambda cv, cs: [[0.0, 0.0, c] for c in (float(np.clip(cs, -1.5, 1.5)), 0.1, 0.8, -0.5)], 2),
    "gev": (gev_logpdf, lambda cv, cs: [[-0.45, np.log(0.78), 0.0], [-0.4, np.log(0.4), 0.3], [-0.35, np.log(0.1), 0.7], [-0.3, 0.0, -0.2]], 2),
    "weibull": (weibull_logpdf, lambda cv, cs: [[np.log(max(cv, 1e-3) ** -1.086), 0.0], [0.0, 0.0], [np.log(0.5), -0.7], [np.log(3.0), 0.1]], None),
}
BOUNDS = {"pearson3": (-1.99, 1.99), "gev": (-1.0, 1.0), "weibull": None}


def scores(logpdf, z: np.ndarray, th: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Per candidate: log-likelihood, gradient, upper triangle of the second derivatives (central differences)."""
    m, k = th.shape
    h = 1e-4
    moves = [np.zeros(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for i in range(k):
        moves += [h * np.eye(k)[i], -h * np.eye(k)[i]]
    for i, j in pairs:
        if i != j:
            moves += [h * (np.eye(k)[i] + s * np.eye(k)[j]) * t for s in (1, -1) for t in (1, -1)]
    each = logpdf(z, (th[:, None, :] + np.array(moves)[None]).reshape(-1, k))
    ll = (each.sum(axis=1) if weights is None else each @ weights).reshape(m, -1)
    out = [ll[:, 0]] + [(ll[:, 1 + 2 * i] - ll[:, 2 + 2 * i]) / (2 * h) for i in range(k)]
    at = 1 + 2 * k
    for i, j in pairs:
        if i == j:
            out.append((ll[:, 1 + 2 * i] - 2 * ll[:, 0] + ll[:, 2 + 2 * i]) / h**2)
        else:
            pp, mm, pm, mp = ll[:, at], ll[:, at + 1], ll[:, at + 2], ll[:, at + 3]
            out.append((pp + mm - pm - mp) / (4 * h * h))
            at += 4
    return np.stack(out, 1).ravel()


def next_state(state: np.ndarray, sums: np.ndarray, k: int, bounded, limits) -> np.ndarray:
    """state = [done, converged, best ll, theta, candidates]; takes the sums of all candidates."""
    size = 1 + k + k * (k + 1) // 2
    best, theta = state[2], state[3: 3 + k]
    cand, got = state[3 + k:].reshape(-1, k), sums.reshape(-1, size)
    j = int(np.argmax(np.where(np.isfinite(got[:, 0]), got[:, 0], -np.inf)))
    gain = got[j, 0] - best
    if not gain > 0:
        # nothing gained: a tenth of the same steps, until they are too short to matter
        nearer = theta + 0.1 * (cand - theta)
        over = np.abs(nearer - theta).max() < 1e-8
        return np.concatenate(([float(over), state[1], best], theta, nearer.ravel()))
    theta, best = cand[j], got[j, 0]
    g = got[j, 1: 1 + k].copy()
    hess = np.zeros((k, k))
    hess[np.triu_indices(k)] = got[j, 1 + k:]
    hess = hess + np.triu(hess, 1).T
    free = np.ones(k, bool)
    if limits is not None:
        lo, hi = limits
        free[bounded] = not (theta[bounded] <= lo + 1e-9 and g[bounded] < 0 or theta[bounded] >= hi - 1e-9 and g[bounded] > 0)
    g, hess = g[free], hess[np.ix_(free, free)]
    if not np.all(np.isfinite(hess)) or not np.all(np.isfinite(g)):
        hess, g = -np.eye(len(g)), np.nan_to_num(g)
    w, v = np.linalg.eigh(hess)
    w = np.abs(w)
    top = max(w.max(initial=0.0), 1e-12)
    along = v.T @ g
    decrement = float((along**2 / np.maximum(w, 1e-9 * top)).sum()) / 2
    out = []
    for damping, length in STEPS:
        step = np.zeros(k)
        step[free] = length * (v @ (along / (np.maximum(w, 1e-9 * top) + damping * top)))
        longest = np.abs(step).max(initial=0.0)
        new = theta + step * min(1.0, 1.5 / longest if longest > 0 else 1.0)
        if limits is not None:
            new[bounded] = np.clip(new[bounded], *limits)
        out.append(new)
    # at the limit of the shape differences reach over the support's end: a gain of nothing ends it there
    held = limits is not None and not free[bounded] and gain < 1e-6 * max(1.0, abs(best))
    near = decrement < TOLERANCE * max(1.0, abs(best)) or held
    return np.concatenate(([float(near), float(near), best], theta, np.array(out).ravel()))


def cells_of(z: DataFrame) -> DataFrame:
    """(post, cells: array of (n, mean, least, most)) of ``z(post, z)``; the counts add up before the shuffle."""
    d = z.groupBy("post", F.floor(F.asinh("z") * CELLS).alias("cell")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("least"), F.max("z").alias("most"))
    return d.groupBy("post").agg(F.sort_array(F.collect_list(F.array("least", "mean", "n", "most"))).alias("cells"))


def points_of(cells) -> tuple[np.ndarray, np.ndarray]:
    """Values and weights of a histogram; its smallest and largest value stand alone, as they bound the support."""
    c = np.stack([np.asarray(x, float) for x in cells])
    mean, n = c[:, 1].copy(), c[:, 2].copy()
    ends = []
    for i, v in ((0, c[0, 0]), (len(c) - 1, c[-1, 3])):
        if n[i] > 1:
            mean[i] = (mean[i] * n[i] - v) / (n[i] - 1)
            n[i] -= 1
            ends.append(v)
    return np.concatenate((mean, ends)), np.concatenate((n, np.ones(len(ends))))


def near_theta(logpdf, cells, first: np.ndarray, bounded, limits) -> np.ndarray | None:
    """Where the steps over a histogram end; none where they do not settle or end at a limit of the shape.

    At the limit the likelihood hangs on single values at the end of the support, which cells blur.
    """
    k = first.shape[1]
    z, w = points_of(cells)
    state = np.concatenate(([0.0, 0.0, -1e300], first[0], first.ravel()))
    for _ in range(ROUNDS):
        if state[0]:
            break
        state = next_state(state, scores(logpdf, z, state[3 + k:].reshape(-1, k), w), k, bounded, limits)
    theta = state[3: 3 + k]
    at_limit = limits is not None and min(abs(theta[bounded] - limits[0]), abs(theta[bounded] - limits[1])) < 1e-3
    return theta if state[1] and not at_limit else None


def fit(df: DataFrame, law: str, bounds: tuple[float, float] | None = None, least: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """(post, n, theta, loglik, converged, at_bound); theta on the scale of the values.

    ``bounds`` limit the shape (skewness, GEV shape): beyond skewness 2 the Pearson III likelihood has
    no maximum.  ``at_bound`` tells that the limit decides; ``converged`` that the remaining gain is nil.
    """
    if law not in LAWS:
        raise ValueError(f"unknown law {law!r}; known: {', '.join(LAWS)}")
    logpdf, begin, bounded = LAWS[law]
    limits = (bounds or BOUNDS[law]) if bounded is not None else None
    k = 3 if bounded is not None else 2
    width = len(STEPS)
    size = 1 + k + k * (k + 1) // 2
    m = moments(df).filter((F.col("n") >= least) & (F.col("std") > 0)).select("post", "n", "mean", "std", "cs")
    shift, scale = (F.col("mean"), F.col("std")) if bounded is not None else (F.lit(0.0), F.col("mean"))
    facts = staged(m.select("post", "n", shift.alias("shift"), scale.alias("scale"), (F.col("std") / F.col("mean")).alias("cv"), F.coalesce("cs", F.lit(0.0)).alias("cs")))

    # facts and state hold one row per post and are written, so their sizes are known where blocks meet them
    z = (F.col("value") - F.col("shift")) / F.col("scale")
    values = observed(df).select("post", "value", block_of(F.col("t")).alias("ob")).join(facts.select("post", "shift", "scale"), "post")
    packed = staged(values.groupBy("post", "ob").agg(F.collect_list(z).alias("a")).drop("ob"))
    cells = cells_of(packed.select("post", F.explode("a").alias("z")))

    @F.pandas_udf(_D)
    def start(cv: pd.Series, cs: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for a, b, h in zip(cv, cs, cells):
            c = np.array(begin(a, b))
            c = np.concatenate((c, np.repeat(c[:1], width - len(c), 0)))
            if limits is not None:
                c[:, bounded] = np.clip(c[:, bounded], *limits)
            near = near_theta(logpdf, h, c, bounded, limits)
            if near is not None:
                c = np.concatenate((near[None], c[:-1]))
            out.append(np.concatenate(([0.0, 0.0, -1e300], c[0], c.ravel())))
        return pd.Series(out)

    @F.pandas_udf(_D)
    def score(a: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([scores(logpdf, np.asarray(x, float), np.asarray(s, float)[3 + k:].reshape(-1, k)) for x, s in zip(a, state)])

    @F.pandas_udf(_D)
    def move(state: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([next_state(np.asarray(s, float), np.asarray(x, float), k, bounded, limits) for s, x in zip(state, sums)])

    state = staged(facts.join(cells, "post").select("post", start("cv", "cs", "cells").alias("state")))
    for _ in range(rounds):
        open_ = state.filter(F.col("state")[0] == 0)
        if open_.isEmpty():
            break
        s = packed.join(open_, "post").select("post", "state", score("a", "state").alias("r"))
        sums = F.array(*[F.sum(F.col("r")[i]) for i in range(width * size)])
        moved = s.groupBy("post").agg(sums.alias("sums"), F.any_value("state").alias("state")).select("post", move("state", "sums").alias("state"))
        state = staged(state.filter(F.col("state")[0] == 1).unionByName(moved))
    t = [F.col("state")[3 + i] for i in range(k)]
    theta = F.array(F.col("shift") + F.col("scale") * t[0], t[1] + F.log("scale"), t[2]) if bounded is not None else F.array(t[0], t[1] + F.log("scale"))
    edge = F.lit(False) if limits is None else (t[bounded] <= limits[0] + 1e-6) | (t[bounded] >= limits[1] - 1e-6)
    return state.join(facts, "post").select(
        "post", "n", theta.alias("theta"), (F.col("state")[2] - F.col("n") * F.log("scale")).alias("loglik"),
        (F.col("state")[1] == 1).alias("converged"), edge.alias("at_bound"))
