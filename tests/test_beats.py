"""Spectra and functions over windows, against loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftline import plans
from driftline.operators import beats, frames, series
from driftline.params import BeatRules

S = 1_000_000


def test_spectra_of_trailing_windows_against_a_loop(spark):
    rng = np.random.default_rng(6)
    rules = BeatRules(window_s=60, nperseg=64, min_coverage=0.5)
    rows, points = [], []
    for e in range(3):
        rr = 800 + 60 * np.sin(np.arange(500) / 5) + rng.normal(0, 20, 500)
        t = np.cumsum(rr) / 1000
        keep = rng.random(500) > 0.1
        if e == 2:
            keep[100:] = False
        rows += [(e, int(a * S), float(b), bool(k)) for a, b, k in zip(t, rr, keep, strict=True)]
        points += [(e, int(x * S)) for x in range(0, 400, 7)]
    beat = spark.createDataFrame(rows, "entity int, us long, rr double, keep boolean")
    got = {(r["entity"], r["us"]): (r["ln_hf"], r["ln_lf_hf"]) for r in beats.spectra(beat, spark.createDataFrame(points, "entity int, us long"), rules, chunk_s=100).collect()}
    assert len(got) == len(points)
    some = 0
    for e, us in points:
        own = [(u, x) for k, u, x, keep in rows if k == e and keep and us - 60 * S < u <= us]
        want = None
        if len(own) >= 8 and sum(x for _, x in own) >= 0.5 * 60_000:
            t, x = np.array([u for u, _ in own]) / S, np.array([x for _, x in own])
            at = np.arange(t[0], t[-1], 0.25)
            if len(at) >= 64:
                f, p = beats.welch(beats.not_a_knot(t, x, at), 4.0, 64)
                low, high = p[(f >= 0.04) & (f < 0.15)].sum() * f[1], p[(f >= 0.15) & (f <= 0.4)].sum() * f[1]
                want = (np.log(high), np.log(low / high))
        some += want is not None
        assert got[e, us] == (None, None) if want is None else np.allclose(got[e, us], want)
    assert 20 < some < len(points)


def test_high_band_is_closed():
    """A tone at 0.40 Hz is in the high band, one at 0.15 Hz isn't in the low one."""
    rules = BeatRules(nperseg=160, rate=4.0)
    t = np.arange(0, 400, 0.5)
    high = beats.log_bands(t, 1000 + 50 * np.sin(2 * np.pi * 0.40 * t), rules)
    edge = beats.log_bands(t, 1000 + 50 * np.sin(2 * np.pi * 0.15 * t), rules)
    assert high[1] < -3 and edge[1] < 0


def test_spectral_queries_have_values(spark, sf_dir):
    found = plans.queries()
    rows = found["spectral_bands"](spark, sf_dir).collect()
    assert len({(r["entity"], r["us"]) for r in rows}) == len(rows) and any(r["ln_hf"] is not None for r in rows)
    every = found["hrv_all_features"](spark, sf_dir)
    assert every.columns == ["event_id", "ln_rmssd", "sdnn", "ln_hf", "ln_lf_hf"]
    assert every.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_rolling_apply_over_chunks(spark):
    df = spark.createDataFrame([(e, int(t * S), None if t == 7 else float(t * t % 11)) for e in range(2) for t in range(40)], "entity int, us long, value double").withColumn("extra", F.lit("x"))
    got = {(r["entity"], r["us"] // S): r["n"] for r in frames.rolling_apply(df, 6, lambda t, x: float(len(x) + x.sum() / 100), "n", chunk_s=5).collect()}
    for (_, t), n in got.items():
        x = [float(u * u % 11) for u in range(max(0, t - 3), min(39, t + 3) + 1) if u != 7]
        assert np.isclose(n, len(x) + sum(x) / 100)
    assert len(got) == 80


def test_per_entity_rows_come_in_time_order(spark):
    df = spark.createDataFrame([(1, 3, 1.0), (1, 1, 2.0), (2, 5, 7.0)], "entity long, us long, value double")
    got = frames.per_entity(df, lambda rows: rows.assign(value=rows["value"].cumsum())[["entity", "us", "value"]], "entity long, us long, value double").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2.0), (1, 3, 3.0), (2, 5, 7.0)]
    assert series.S == S
