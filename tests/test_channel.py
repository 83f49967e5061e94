import pytest

from hydrosheaf.functions import fixed
from hydrosheaf.operators import channel, flow, freq

# fixed values: golden table of the sample profile (level, discharge, area)
GOLDEN = [(31.0, 0.333, 1.700), (31.5, 5.135, 16.700), (32.0, 28.039, 54.200), (32.5, 78.950, 110.450),
          (33.0, 159.359, 179.200), (33.5, 284.023, 257.325), (34.0, 441.286, 341.700)]


def test_golden_discharge(spark):
    pts = [(0, 30.66, 3), (10, 31.0, 0), (50, 31.5, 2), (100, 32.0, 0), (150, 33.0, 2), (200, 35.0, 0)]
    p = spark.createDataFrame([("A", float(b), h, c) for b, h, c in pts], "profile string, b double, h double, code int")
    lv = spark.createDataFrame([("A", h) for h, _, _ in GOLDEN], "profile string, level double")
    dims = spark.createDataFrame([("A", 0.0005, 0.025, 0.035, 0.035)], "profile string, slope double, n_channel double, n_left double, n_right double")
    got = {r.level: r for r in channel.composite_discharge(p, lv, dims).collect()}
    for h, q, area in GOLDEN:
        assert abs(got[h].q - q) < 2e-3 and abs(got[h].area - area) < 1e-3, h


def test_structure_classes(spark):
    rows = [(120.0, None, "I"), (60.0, None, "II"), (25.0, None, "III"), (8.0, None, "IV"), (None, 1500.0, "I"), (None, 50.0, "III"), (None, None, "I")]
    df = spark.createDataFrame(rows, "height double, volume double, want string")
    assert all(r.structure_class == r.want for r in freq.classify_structures(df).collect())
    assert fixed.STRUCTURE_P["I"] == (0.001, 0.0001, 0.95, 0.97)


def test_months_from_text():
    assert flow.months_from_text("11-3") == [11, 12, 1, 2, 3]
    assert flow.months_from_text("4, 6-8") == [4, 6, 7, 8]
    with pytest.raises(ValueError):
        flow.months_from_text("0-3")


def test_constant_series_has_zero_index(spark):
    df = spark.createDataFrame([("a", k, 4.0) for k in range(12)], "post string, t bigint, value double")
    assert {r.spi for r in flow.spi(df, 3).collect()} == {0.0}


def test_open_drought(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.0, -2.0, -1.5, 0.0, -3.0])], "post string, t bigint, spi double")
    assert flow.drought_events(df).count() == 2
    assert flow.drought_events(df, keep_open=False).count() == 1
