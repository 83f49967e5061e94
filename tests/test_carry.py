"""Block maps of recurrences: equal to running the rows, composable, linear in the rows."""
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrosheaf.operators import flow
from hydrosheaf.plans import carry

ALPHA = 0.925
flows = st.lists(st.floats(-50, 100) | st.sampled_from([0.0, 1.0, 2.0, 4.0]), min_size=1, max_size=40)
states = st.floats(-100, 300)


def end(run, state, *cols):
    out = run(state, *cols)
    return out[-1]


@settings(max_examples=300, deadline=None)
@given(flows, flows, states, st.booleans())
def test_filter_maps_follow_the_rows(a, b, s, begins):
    summary, run = flow._filter_summary(ALPHA), flow._filter_run(ALPHA)
    a, b = np.array(a), np.array(b)
    fa, fb = np.zeros(len(a)), np.zeros(len(b))
    fa[0] = begins
    one, two = summary(a, fa), summary(b, fb)
    follow = lambda f, x: carry.follow(x, np.asarray(f[0], float), f[1], f[2])
    # a state that meets a threshold to the last bit may fall on either side
    near = any(abs(s - t) < 1e-6 * max(1, abs(t)) for t in one[0] if np.isfinite(t))
    if not near:
        want = end(run, s, a, fa)
        assert follow(one, s) == pytest.approx(want, abs=1e-9)
        if not any(abs(want - t) < 1e-6 * max(1, abs(t)) for t in two[0] if np.isfinite(t)):
            both = carry.compose(one, two)
            assert list(both[0]) == sorted(both[0])
            assert follow(both, s) == pytest.approx(follow(two, follow(one, s)), abs=1e-9)
            assert follow(both, s) == pytest.approx(end(run, want, b, fb), abs=1e-9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.floats(0, 100), min_size=1, max_size=20), min_size=1, max_size=5), st.floats(0, 300))
def test_lyne_maps_compose(blocks, s):
    summary, run = flow._lyne_summary(0.97), flow._lyne_run(0.97)
    x = np.concatenate([np.array(b) for b in blocks])
    prev = np.concatenate(([np.nan], x[:-1]))
    cuts = np.cumsum([0] + [len(b) for b in blocks])
    f = None
    for a, b in zip(cuts, cuts[1:]):
        g = summary(x[a:b], prev[a:b])
        f = carry.compose(f, g) if f else g
    assert carry.follow(s, np.asarray(f[0], float), f[1], f[2]) == pytest.approx(end(run, s, x, prev), abs=1e-9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 8)), min_size=2, max_size=30), st.integers(0, 9), st.integers(0, 60), st.integers(1, 29))
def test_peak_maps_compose(gaps, sep, s, cut):
    starts, at = [], 0
    ends = []
    for gap, length in gaps:
        starts.append(at + gap)
        at = at + gap + length
        ends.append(at)
    x, y = np.array(starts, float), np.array(ends, float)
    cut = min(cut, len(x) - 1)
    summary = flow._pot_summary(sep)
    follow = lambda f, v: carry.follow(v, np.asarray(f[0], float), f[1], f[2])
    whole, parts = summary(x, y), carry.compose(summary(x[:cut], y[:cut]), summary(x[cut:], y[cut:]))
    pos = s
    for e in y:
        if e >= pos:
            pos = e + 1 + sep
    assert follow(whole, s) == follow(parts, s) == pos


@pytest.mark.parametrize("shape", ["falling", "rising", "noise", "waves"])
def test_filter_summary_is_linear(shape):
    t = np.arange(4096)
    x = {"falling": 5000.0 - t, "rising": 10.0 + t, "noise": np.random.default_rng(1).gamma(2.0, 10.0, 4096), "waves": 50 + 40 * np.sin(t / 9)}[shape]
    summary = flow._filter_summary(ALPHA)
    best = np.inf
    for _ in range(5):
        start = time.perf_counter()
        theta, _, _ = summary(x, np.zeros(4096))
        best = min(best, time.perf_counter() - start)
    assert len(theta) <= 1           # flows of zero or more leave one interval that was reset
    assert best < 0.1, best
    print(shape, round(best * 1000, 2), "ms")
