"""Median pairwise slopes by slope selection against all pairs."""

import numpy as np
import pandas as pd
import pytest

from hydrosheaf.operators import slopes


def every_slope(t, v):
    return np.concatenate([(v[k + 1:] - v[k]) / (t[k + 1:] - t[k]) for k in range(len(t) - 1)]) if len(t) > 1 else np.zeros(1)


def test_counts_and_lists_of_chunks():
    rng = np.random.default_rng(5)
    for ties in (False, True):
        t = np.sort(rng.choice(900, 300, replace=False)).astype(float)
        v = rng.standard_normal(300) * 10 + 0.02 * t
        v = np.round(v / 4) * 4 if ties else v
        a, b = slice(0, 140), slice(140, 300)
        pairs = {"same": (t[a], v[a], t[a], v[a], True), "two": (t[a], v[a], t[b], v[b], False)}
        cross = np.concatenate([(v[b] - v[i]) / (t[b] - t[i]) for i in range(140)])
        for kind, want in (("same", every_slope(t[a], v[a])), ("two", cross)):
            for x in (-0.3003, 0.0111, 0.2003):        # between tied slopes
                assert slopes._below(*pairs[kind], x) == (want < x).sum()
            for low, high in ((-0.0503, 0.0701), (-np.inf, -0.2003), (0.3003, np.inf), (-np.inf, np.inf)):
                got = slopes._between(*pairs[kind], low, high)
                assert np.allclose(np.sort(got), np.sort(want[(want >= low) & (want < high)]))


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(9)
    parts = {"one": ([5], [1.0]), "two": ([5, 9], [1.0, 4.0]), "flat": (range(60), [2.0] * 60)}
    t = np.sort(rng.choice(4000, 900, replace=False))
    parts["free"] = (t, rng.standard_normal(900) * 5 + 0.01 * t)
    parts["tied"] = (range(500), np.round(rng.gamma(2.0, 3.0, 500)))                 # most slopes are tied
    parts["step"] = (range(400), np.repeat([0.0, 1.0], 200) + np.tile([0.0, 0.0, 1.0, 1.0], 100))
    parts["zero"] = (range(300), np.where(np.arange(300) % 11 == 0, rng.standard_normal(300), 0.0))   # more than half of the slopes are 0
    parts["far"] = (1_700_000_000 + 86_400 * np.arange(400), 1e6 + rng.standard_normal(400))
    parts["steep"] = (range(300), np.cumsum(rng.standard_cauchy(300)))
    pdf = pd.concat([pd.DataFrame({"post": p, "t": np.asarray(a, np.int64), "value": np.asarray(b, float)}) for p, (a, b) in parts.items()])
    gap = pd.DataFrame({"post": ["free", "none"], "t": [5000, 1], "value": [np.nan, np.nan]})
    df = spark.createDataFrame(pd.concat([pdf, gap])).selectExpr("post", "t", "CASE WHEN NOT isnan(value) THEN value END AS value").repartition(3)
    return pdf, df


@pytest.mark.parametrize("sizes", [{}, {"listed": 300, "chunk": 64}])
def test_median_is_that_of_all_slopes(posts, sizes):
    """One pass for short posts; with small chunks and lists the interval is narrowed by counts."""
    pdf, df = posts
    got = {r.post: r.slope for r in slopes.median_slopes(df, **sizes).collect()}
    assert set(got) == set(pdf.post)
    for post, g in pdf.groupby("post"):
        g = g.sort_values("t")
        s = every_slope(g.t.to_numpy(float), g.value.to_numpy())
        assert abs(got[post] - np.median(s)) <= 1e-9 * max(np.abs(s).max(), 1e-300), post
