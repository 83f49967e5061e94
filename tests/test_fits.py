import numpy as np
import pandas as pd

from hydrosheaf.operators import analog, fits, freq, likelihood


def one_post(spark, x):
    return spark.createDataFrame(pd.DataFrame({"post": "a", "t": np.arange(len(x)), "value": x}))


def test_likelihood_of_split_posts(spark, series, monkeypatch):
    _, df = series
    small = df.filter("post = 'tied'")
    whole = likelihood.fit(small, "gev").toPandas().iloc[0]
    monkeypatch.setattr(likelihood, "block_of", lambda t: likelihood.F.floor(t / 16))
    split = likelihood.fit(small, "gev").toPandas().iloc[0]
    assert whole.converged and split.converged
    assert abs(split.loglik - whole.loglik) < 1e-6 and np.allclose(split.theta, whole.theta, rtol=1e-4, atol=1e-4)


def test_heavy_tails_reach_the_maximum(spark):
    rng = np.random.default_rng(5)
    pareto, lognormal = rng.pareto(1.5, 500) * 10 + 1, np.exp(rng.normal(0, 1.5, 500))
    a = likelihood.fit(one_post(spark, pareto), "gev").toPandas().iloc[0]
    b = likelihood.fit(one_post(spark, lognormal), "gev").toPandas().iloc[0]
    assert a.loglik > -1770.7 and a.converged and not a.at_bound
    assert b.loglik > -947.6 and b.at_bound


def test_fit_is_a_maximum(spark, series):
    pdf, df = series
    for law, logpdf in (("gev", likelihood.gev_logpdf), ("pearson3", likelihood.p3_logpdf)):
        for r in likelihood.fit(df, law).toPandas().itertuples():
            x = pdf[pdf.post == r.post].value.to_numpy()
            th = np.array(r.theta)[None, :]
            best = logpdf(x, th).sum()
            assert abs(best - r.loglik) < 1e-6
            if not r.converged or r.at_bound:
                continue
            for j in range(3):
                for step in (-0.02, 0.02):
                    other = th.copy()
                    other[0, j] += step * max(1.0, abs(other[0, j]))
                    assert logpdf(x, other).sum() <= best + 1e-6


def test_unknown_laws_are_refused(spark, series):
    import pytest

    with pytest.raises(ValueError):
        likelihood.fit(series[1], "cauchy")
    with pytest.raises(ValueError):
        fits.law_fits(series[1], "cauchy")


def test_ratio_search_against_loop(spark, series):
    from hydrosheaf.functions.special import pearson3_z

    pdf, df = series
    x = np.sort(pdf[pdf.post == "tied"].value.to_numpy())[::-1]
    n, mean = len(x), x.mean()
    cv = x.std(ddof=1) / mean
    p = (np.arange(1, n + 1) - 0.3) / (n + 0.4)
    best = min((((x - np.maximum(mean + mean * cv * pearson3_z(p, r * cv), 0)) ** 2).sum(), r) for r in np.round(np.arange(0.5, 4.01, 0.5), 6))
    got = freq.best_ratio(df.filter("post = 'tied'"), lo=0.5, hi=4.0, step=0.5).toPandas().iloc[0]
    assert got.ratio == best[1] and abs(got.ss - best[0]) < 1e-6 * best[0]


def test_bootstrap_is_repeatable_and_centred(spark, series):
    pdf, df = series
    one = df.filter("post <> 'long'")
    a = fits.bootstrap_params(one, 200).orderBy("post", "rep").toPandas()
    b = fits.bootstrap_params(one, 200).orderBy("post", "rep").toPandas()
    pd.testing.assert_frame_equal(a, b)
    for post, g in a.groupby("post"):
        x = pdf[pdf.post == post].value
        assert abs(g["mean"].mean() - x.mean()) < 4 * x.std() / np.sqrt(len(x)) / np.sqrt(200) + 1e-9
        assert (g.n == len(x)).all()


def test_bootstrap_split_into_blocks_keeps_the_draw_count(spark, series):
    pdf, df = series
    g = fits.bootstrap_params(df.filter("post = 'long'"), 50, width=128).toPandas()
    assert (g.n == 700).all()
    x = pdf[pdf.post == "long"].value
    assert abs(g["mean"].mean() - x.mean()) < x.std() / np.sqrt(700)


def test_bands_are_percentiles_of_the_resampled_curves(spark, series):
    from hydrosheaf.functions.special import pearson3_z

    _, df = series
    one = df.filter("post = 'tied'")
    got = fits.bootstrap_bands(one, (0.01, 0.5), replicates=60).orderBy("p").toPandas()
    g = fits.bootstrap_params(one, 60).toPandas()
    for p, row in zip((0.01, 0.5), got.itertuples()):
        z = np.array([pearson3_z(np.array([p]), c)[0] for c in g.cs])
        q = np.maximum(g["mean"] + g["mean"] * np.maximum(g.cv.abs(), 0.001) * z, 0)
        assert np.allclose([row.q_low, row.q_high, row.std_error], [*np.percentile(q, [2.5, 97.5]), q.std(ddof=1)], rtol=1e-9)


def test_blocks_share_all_draws_by_their_size():
    n, width, blocks = 1000, 64, 16
    shares = np.stack([fits.block_draws(7, "post", b, blocks, n, width, 400) for b in range(blocks)])
    assert (shares.sum(axis=0) == n).all() and shares.min() >= 0
    size = np.array([width] * 15 + [n - 15 * width])
    spread = np.sqrt(n * size / n * (1 - size / n) / 400)
    assert (np.abs(shares.mean(axis=1) - size) < 5 * spread).all()
    # the variance is that of a multinomial
    assert np.allclose(shares.var(axis=1), size * (1 - size / n), rtol=0.35)


def test_sums_of_draws_do_not_depend_on_how_many_are_held(monkeypatch):
    x, draws = np.arange(10.0), np.array([5, 0, 7, 100, 1])
    whole = fits.block_sums(1, "p", 2, x, draws)
    monkeypatch.setattr(fits, "DRAWS", 6)
    assert (fits.block_sums(1, "p", 2, x, draws) == whole).all() and (whole[:, 0] == draws).all()
    many = fits.block_sums(1, "p", 2, x, np.full(200, 500))
    assert abs(many[:, 1].sum() / 100_000 - 4.5) < 0.05 and abs(many[:, 2].sum() / 100_000 - 28.5) < 0.5


def test_multi_analog_against_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(4, 10, (30, 3))
    y = 5 + x @ [0.4, 0.2, 0.3] + rng.normal(0, 1, 30)
    rows = [("c", t, float(y[t])) for t in range(24)] + [(f"a{j}", t, float(x[t, j])) for j in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "post string, t bigint, value double")
    pairs = spark.createDataFrame([("c", f"a{j}", j + 1) for j in range(3)], "target string, analog string, k bigint")
    wide = analog.wide_analogs(df, pairs)
    fit = analog.multi_analog_fit(wide)
    got = fit.toPandas().iloc[0]
    a = np.column_stack([np.ones(24), x[:24]])
    beta, rss, *_ = np.linalg.lstsq(a, y[:24], rcond=None)
    assert np.allclose([got[f"k{j}"] for j in range(4)], beta, atol=1e-8)
    r2 = 1 - rss[0] / ((y[:24] - y[:24].mean()) ** 2).sum()
    assert abs(got.r - np.sqrt(r2)) < 1e-9 and got.r_ok
    ext = analog.multi_analog_extension(wide, fit).filter("filled").toPandas()
    assert len(ext) == 6
    want = np.column_stack([np.ones(6), x[24:]]) @ beta
    assert np.allclose(ext.sort_values("t").value, want, atol=1e-7)


def test_outlying_partial_estimate_is_dropped(spark):
    from hydrosheaf.operators.analog import _weighted

    q = [10.0] * 12 + [10.5, 9.5, 500.0, -3.0]
    df = spark.createDataFrame([(q, [1.0] * len(q))], "q array<double>, w array<double>")
    v, s, k = df.select(_weighted("q", "w").alias("x")).first()["x"]
    assert k == 14 and abs(v - 10.0) < 1e-9 and abs(s - 14 ** -0.5) < 1e-12


def test_histogram_start():
    """Steps over cells end next to the maximum over all values, and cells keep the ends and the sums."""
    rng = np.random.default_rng(3)
    z = rng.gumbel(size=20_000)
    z = (z - z.mean()) / z.std()
    cell = np.floor(np.arcsinh(z) * likelihood.CELLS)
    cells = sorted([x.min(), x.mean(), float(len(x)), x.max()] for x in (z[cell == c] for c in np.unique(cell)))
    points, weights = likelihood.points_of(cells)
    assert weights.sum() == len(z) and abs(points @ weights - z.sum()) < 1e-6
    assert points.min() == z.min() and points.max() == z.max() and len(points) < 700
    logpdf, begin, bounded = likelihood.LAWS["gev"]
    first = np.array(begin(1.0, 1.1))
    near = likelihood.near_theta(logpdf, cells, first, bounded, (-1.0, 1.0))
    state = np.concatenate(([0.0, 0.0, -1e300], near, near))
    rounds = 0
    while not state[0]:
        state = likelihood.next_state(state, likelihood.scores(logpdf, z, state[6:].reshape(-1, 3)), 3, bounded, (-1.0, 1.0))
        rounds += 1
    assert state[1] and rounds <= 3 and np.abs(state[3:6] - near).max() < 0.01
    first[:, bounded] = np.clip(first[:, bounded], -1.0, -0.2)
    assert likelihood.near_theta(logpdf, cells, first, bounded, (-1.0, -0.2)) is None       # the limit decides
