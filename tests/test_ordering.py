"""Many small blocks give the rows of one large block, on posts of very different length."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrosheaf.operators import analog, fits, flow, fourier, freq, quality, stats, tables, trend
from hydrosheaf.plans import ordering as o


def frame(df):
    p = df.toPandas()
    return p[sorted(p.columns)].sort_values(sorted(p.columns)).reset_index(drop=True)


def same(a, b):
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


OPS = {
    "sequence": lambda d: o.sequence(d, width=50).drop("blk"),
    "ranks": lambda d: o.value_ranks(d),
    "parameters": stats.parameters,
    "box": stats.box_stats,
    "fill": lambda d: quality.fill_by_interpolation(d.withColumn("value", F.when(F.col("t") % 7 != 0, F.col("value")))),
    "two_parts": lambda d: quality.two_part_tests(quality.halves(d)),
    "pettitt": trend.pettitt,
    "mann_kendall": trend.mann_kendall,
    "spi": lambda d: flow.spi(d, 5),
    "droughts": lambda d: flow.drought_events(flow.spi(d, 3), -0.5),
    "pot": lambda d: flow.peaks_over_threshold(d, 80.0, 3),
    "straight": flow.baseflow_straight_line,
    "filter": flow.baseflow_digital_filter,
    "lyne": flow.baseflow_lyne_hollick,
    "hurst": flow.hurst,
    "integral": analog.integral_curves,
    "quantiles": lambda d: freq.empirical_quantiles(d, (0.01, 0.3, 0.9)),
    "fit_quality": lambda d: fits.goodness_of_fit(d, "normal"),
    "l_moments": freq.l_moments,
}


@pytest.mark.parametrize("name", OPS)
def test_small_blocks_give_the_rows_of_large_ones(spark, series, name, monkeypatch):
    _, df = series
    plain = frame(OPS[name](df))
    assert len(plain)
    monkeypatch.setattr(o, "VALUE_BLOCK", 40)
    for fn in (o.sequence, o.rolling):
        monkeypatch.setattr(fn, "__defaults__", tuple(50 if v == o.BLOCK else v for v in fn.__defaults__))
    monkeypatch.setattr("hydrosheaf.plans.carry.BLOCK_ROWS", 37)
    monkeypatch.setattr("hydrosheaf.plans.carry.FAN", 3)
    same(frame(OPS[name](df)), plain)


def test_value_blocks_are_really_cut(spark, series):
    pdf, df = series
    r = o.value_ranks(df, limit=20).toPandas()
    for post, g in pdf.groupby("post"):
        got = r[r.post == post].sort_values("value")
        want = g.value.value_counts().sort_index()
        assert got.c.tolist() == want.tolist()
        assert got.below.tolist() == (want.cumsum() - want).tolist()


def test_sign_sum_by_tiles_against_pairs(spark, series):
    pdf, df = series
    got = dict(trend.sign_sum(df, side=8).toPandas().values.tolist())
    for post, g in pdf.groupby("post"):
        v = g.sort_values("t").value.to_numpy()
        want = sum(np.sign(v[k + 1:] - v[k]).sum() for k in range(len(v)))
        assert got[post] == want, post


@pytest.mark.parametrize("piece", [None, 16, 64])
def test_spectrum_in_pieces(spark, series, piece):
    """One task per step, or groups of a few rows and columns of the matrix."""
    pdf, df = series
    got = flow.spectrum(df, "hanning", piece=piece).toPandas()
    for post, g in pdf.groupby("post"):
        v = g.sort_values("t").value.to_numpy()
        y = np.fft.rfft((v - v.mean()) * np.hanning(len(v)))[1:len(v) // 2 + 1]
        p = got[got.post == post].sort_values("k")
        assert p.k.tolist() == list(range(1, len(v) // 2 + 1))
        assert np.allclose(p.re, y.real, atol=1e-7) and np.allclose(p.im, y.imag, atol=1e-7)


def test_fourier_sums_of_every_length(spark):
    """Awkward lengths, powers of two and lengths next to them, in one table."""
    rng = np.random.default_rng(2)
    sizes = [*range(1, 36), 63, 64, 65, 127, 128, 129, 257, 509, 1024, 1531]
    series = {f"s{n}": rng.standard_normal(n) for n in sizes}
    rows = [(p, len(v), m, float(x)) for p, v in series.items() for m, x in enumerate(v)]
    got = fourier.fourier_sums(spark.createDataFrame(rows, "post string, n bigint, m bigint, x double"), 128).toPandas()
    for post, v in series.items():
        p = got[got.post == post].sort_values("k")
        y = np.fft.fft(v)[1:len(v) // 2 + 1] if len(v) >= 4 else np.zeros(0)
        assert p.k.tolist() == list(range(1, len(y) + 1))
        assert np.allclose(p.re + 1j * p.im, y, atol=1e-9)


def test_pair_sums_in_tiles(spark):
    rng = np.random.default_rng(1)
    wide = pd.DataFrame(rng.normal(10, 2, (40, 9)), columns=[f"p{k}" for k in range(9)])
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    long = wide.reset_index(names="t").melt("t", var_name="post", value_name="value").dropna()
    got = stats.correlation_matrix(spark.createDataFrame(long), tile=2).toPandas()
    want = wide.corr()
    assert len(got) == 36
    for r in got.itertuples():
        assert abs(r.r - want.loc[r.post_a, r.post_b]) < 1e-9


def test_snow_store_closed_form(spark):
    t = [3.0, -2.0, 5.0, 8.0, 4.0, -1.0, 9.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(t)], "post string, t bigint, value double")
    store = spark.createDataFrame([("a", 60.0)], "post string, w0 double")
    got = tables.snowmelt(df, store).toPandas().sort_values("t")
    w, rem = 60.0, []
    for v in t:
        w -= min(3.5 * 0.85 * max(v, 0), w)
        rem.append(w)
    assert np.allclose(got.remaining, rem)
