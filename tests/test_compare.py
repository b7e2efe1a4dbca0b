"""Series along sessions, lags around onsets, zones and distributions, by hand and against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import align, compare, inflection, stats
from driftline.params import InflectionRules

S = 1_000_000


def plain_lags(t, value, sd, onsets, half, share=0.7):
    """The definition, with numpy on one series."""
    grid = np.arange(np.ceil(t[0]), np.floor(t[-1]) + 1)
    filled = np.where(np.isnan(sd), np.nanmean(sd), sd)
    slopes = []
    for y in (value, filled):
        g = np.pad(np.interp(grid, t, y), 7, mode="edge")
        slopes.append(np.round(np.gradient(np.convolve(g, np.ones(15) / 15, mode="valid")), 9))
    out = {}
    for o in onsets:
        inside = np.flatnonzero((grid >= o - half) & (grid <= o + half))
        if len(inside) >= int(2 * half * share):
            v, s = (grid[inside[int(np.argmin(d[inside]))]] for d in slopes)
            out[o] = (v, s, s - v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lags_equal_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    rows, marks, want = [], [], {}
    for entity in (1, 2):
        t = np.unique(rng.integers(0, 900_000, 180)) / 1000 + 0.5
        value = 60 - 5 / (1 + np.exp(-(t - 400) / 20)) + rng.normal(0, 0.4, len(t))
        sd = np.where(np.arange(len(t)) < 3, np.nan, rng.gamma(2, 1, len(t)))
        onsets = [5.0, 300.0, 410.0, 880.0]  # the first and the last lack most of their windows
        want |= {(entity, round(o * S)): v for o, v in plain_lags(t, value, sd, onsets, 60).items()}
        rows += [(entity, round(a * S), float(v), None if np.isnan(s) else float(s)) for a, v, s in zip(t, value, sd, strict=True)]
        marks += [(entity, round(o * S)) for o in [*onsets, onsets[1]]]
    rules = InflectionRules(half_s=60)
    slopes = inflection.smoothed_slopes(spark.createDataFrame([*rows, (3, 5, None, 1.0)], "entity long, us long, value double, sd double"), rules)
    got = inflection.inflection_lags(slopes, spark.createDataFrame([*marks, (3, 5), (4, None)], "entity long, us long"), rules).collect()
    assert {(r["entity"], r["onset_us"]): (r["value_us"] / S, r["sd_us"] / S, r["lag_s"]) for r in got} == want and len(got) == len(want) == 4


def test_zones(spark):
    def check(*shifts):
        return tuple(align.zone_check(spark.createDataFrame([(m,) for m in shifts], "best_m long"), 30).first())

    assert check(120, -240, None) == (2, 0.0, True)
    assert check(121, 359) == (2, 30.0, True)
    assert check(120, 150) == (2, 900.0, False)
    assert check(60) == (1, 1800.0, False)  # half an hour
    assert check(None) == (0, None, None)


def test_distributions(spark):
    rows = spark.createDataFrame([(1.0, None), (-4.0, None), (2.0, None), (None, None)], "a double, b double")
    got = {r["measure"]: tuple(r)[1:] for r in stats.distributions(rows, ["a", "b"]).collect()}
    assert got["a"] == (3, -4.0, -1.5, 1.0, 1.5, 2.0, pytest.approx(-1 / 3), 2.0)
    assert got["b"] == (0, *[None] * 7)


def test_series_along_a_session(spark):
    rows = [(1, 0, k * S, float(v)) for k, v in enumerate([4, 6, 1, 100])] + [(1, 0, 10 * S, None), (1, 0, 30 * S, 8.0), (2, 5 * S, 5 * S, 3.0)]
    points = spark.createDataFrame(rows, "id long, start_us long, us long, value double")
    got = {(r["id"], round(r["at_min"] * 60)): (r["value"], r["median"], r["sd"]) for r in compare.rolling_along(points, 2, "id").collect()}
    assert got[1, 0] == (4.0, 5.0, 1.0) and got[1, 3] == (100.0, 50.5, 49.5)
    assert got[1, 10] == (None, None, None) and got[2, 0] == (3.0, 3.0, 0.0)
    # bins of ten seconds: left are 4-5, 6-4, 1-6, 100-50.5, then nothing, then the last on the end of the third
    found = [tuple(r) for r in compare.binned_rms(points, 10, 2, "id").orderBy("id", "at_min").collect()]
    left = [-1.0, 2.0, -5.0, 49.5]
    assert found == [(1, pytest.approx(5 / 60), pytest.approx((sum(x * x for x in left) / 4) ** 0.5)), (1, pytest.approx(15 / 60), 0.0), (1, pytest.approx(25 / 60), 0.0)]
    assert compare.binned_rms(points.where(F.lit(False)), 10, 2, "id").collect() == []
