"""Beat series: ectopic beats, variability in the time domain, spectral bands.
A beat has entity, i (its number), us and rr (ms)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import BeatRules
from .chunks import ROWS, Carried, carried, long_groups, widened
from .series import along, trailing


def in_range(rr: Column, rules: BeatRules = BeatRules()) -> Column:
    return F.coalesce(rr.between(rules.min_rr_ms, rules.max_rr_ms), F.lit(False))


def ectopic_filter(df: DataFrame, rules: BeatRules = BeatRules(), entity: str = "entity") -> DataFrame:
    """Adds keep: false out of range, and for beats that differ by more than a
    share from the median of the preceding in-range beats; with too few of
    those, true."""
    inside = df.where(in_range(F.col("rr"), rules))
    w = along(entity).rowsBetween(-rules.history, -1)
    med = F.percentile(F.col("rr"), F.lit(0.5)).over(w)
    judged = inside.withColumn("_n", F.count("rr").over(w)).withColumn("_med", med)
    keep = (F.col("_n") < rules.history) | (F.abs(F.col("rr") - F.col("_med")) <= rules.max_deviation * F.col("_med"))
    out = df.where(~in_range(F.col("rr"), rules)).withColumn("keep", F.lit(False))
    return judged.withColumn("keep", keep).drop("_n", "_med").unionByName(out)


def variability(df: DataFrame, rules: BeatRules = BeatRules(), entity: str = "entity", rows: int = ROWS) -> DataFrame:
    """Adds ln_rmssd and sdnn over (t - window, t], from kept beats. A
    difference counts if both beats are kept, neighbours, and inside. Null
    with too few beats or too little of the window covered. An entity of more
    than ``rows`` beats is taken in chunks."""
    cuts = long_groups(df, [entity], "us", rows)
    paired = carried(df, [entity], ["us"], {"_prev": Carried("last", F.struct("i", "rr", "keep"))}, cuts)
    pair = F.when(F.col("keep") & F.col("_prev.keep") & (F.col("i") - F.col("_prev.i") == 1), F.col("rr") - F.col("_prev.rr"))
    marked = paired.withColumn("_nn", F.when(F.col("keep"), F.col("rr"))).withColumn("_d2", pair * pair)

    def windows(by: list[str]) -> dict[str, Column]:
        w = trailing(rules.window_s, by, closed=False)
        edge = F.first("_d2").over(w)  # the first beat of the window has its partner outside
        n_pairs = F.count("_d2").over(w) - F.when(edge.isNotNull(), 1).otherwise(0)
        total = F.sum("_d2").over(w) - F.coalesce(edge, F.lit(0.0))
        covered = F.sum("_nn").over(w) >= rules.min_coverage * rules.window_s * 1000
        return {"ln_rmssd": F.when((n_pairs >= 2) & covered & (total > 0), F.log(F.sqrt(total / n_pairs))), "sdnn": F.when((F.count("_nn").over(w) >= 3) & covered, F.stddev_samp("_nn").over(w))}

    return widened(marked, windows, int(rules.window_s * 1_000_000), by=[entity], cuts=cuts).drop("_nn", "_d2", "_prev")


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points, its third derivative continuous at the
    second and last but one of them; four points or more."""
    h, n = np.diff(x), len(x)
    slopes = np.diff(y) / h
    low, mid, high, right = (np.zeros(n) for _ in range(4))
    mid[1:-1], low[1:-1], high[1:-1], right[1:-1] = 2 * (h[:-1] + h[1:]), h[:-1], h[1:], 6 * np.diff(slopes)
    # the end conditions, with the outer unknowns put in terms of their neighbours
    mid[1] += h[0] * (1 + h[0] / h[1])
    high[1] -= h[0] * h[0] / h[1]
    mid[-2] += h[-1] * (1 + h[-1] / h[-2])
    low[-2] -= h[-1] * h[-1] / h[-2]
    for i in range(2, n - 1):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        right[i] -= f * right[i - 1]
    m = np.zeros(n)
    m[-2] = right[-2] / mid[-2]
    for i in range(n - 3, 0, -1):
        m[i] = (right[i] - high[i] * m[i + 1]) / mid[i]
    m[0] = m[1] - h[0] / h[1] * (m[2] - m[1])
    m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d, e = at - x[k], x[k + 1] - at
    return (m[k] * e**3 + m[k + 1] * d**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * e + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * d


def welch(x: np.ndarray, rate: float, size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density): periodograms of half-overlapping Hann windows
    without their means, averaged."""
    size = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = size - size // 2
    parts = [x[a : a + size] for a in range(0, len(x) - size + 1, step)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0) / (rate * (window**2).sum())
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def log_bands(t: np.ndarray, rr: np.ndarray, rules: BeatRules) -> tuple[float, float] | None:
    """(ln HF, ln LF/HF) of beats at ``t`` seconds, with the bands [0.04, 0.15)
    and [0.15, 0.40] Hz; None for too few beats, times that don't rise, a grid
    shorter than a Welch window, or an empty band."""
    if len(t) < rules.min_beats or (np.diff(t) <= 0).any():
        return None
    at = np.arange(t[0], t[-1], 1 / rules.rate)
    if len(at) < rules.nperseg:
        return None
    f, power = welch(not_a_knot(t, rr, at), rules.rate, rules.nperseg)
    low, high = power[(f >= 0.04) & (f < 0.15)].sum() * f[1], power[(f >= 0.15) & (f <= 0.40)].sum() * f[1]
    return (float(np.log(high)), float(np.log(low / high))) if low > 0 and high > 0 else None


def spectra(beats: DataFrame, points: DataFrame, rules: BeatRules = BeatRules(), entity: str = "entity", chunk_s: float = 3_600) -> DataFrame:
    """(entity, us, ln_hf, ln_lf_hf) at each of ``points`` (entity, us): of the
    kept beats of (us - window, us], if there are three or more and their
    intervals cover enough of it; else nulls. Chunks of ``chunk_s`` are tasks of
    their own, with the beats that their first windows reach back to, so no
    task holds an entity's whole series."""
    width, chunk = int(rules.window_s * 1_000_000), int(chunk_s * 1_000_000)
    asked = points.select(entity, "us", F.floor(F.col("us") / chunk).alias("_chunk"), F.lit(None).cast("double").alias("rr")).where("us IS NOT NULL").distinct()
    reach = F.sequence(F.floor(F.col("us") / chunk), F.floor((F.col("us") + width) / chunk))
    given = beats.where("keep").select(entity, "us", F.explode(reach).alias("_chunk"), F.col("rr").cast("double").alias("rr"))

    def at_points(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["rr"].notna()].sort_values("us", kind="stable")
        us, rr = known["us"].to_numpy(), known["rr"].to_numpy()
        when = rows[rows["rr"].isna()]["us"].to_numpy()
        total = np.concatenate([[0.0], np.cumsum(rr)])
        low, high = np.searchsorted(us, when - width, side="right"), np.searchsorted(us, when, side="right")
        out = []
        for a, b in zip(low, high, strict=True):
            covered = b - a >= 3 and (total[b] - total[a]) / 1000 >= rules.min_coverage * rules.window_s
            out.append((log_bands(us[a:b] / 1e6, rr[a:b], rules) if covered else None) or (None, None))
        ln_hf, ln_lf_hf = zip(*out, strict=True) if out else ((), ())
        return pd.DataFrame({entity: [rows[entity].iloc[0]] * len(when), "us": when, "ln_hf": pd.array(ln_hf, "Float64"), "ln_lf_hf": pd.array(ln_lf_hf, "Float64")})

    return asked.unionByName(given).groupBy(entity, "_chunk").applyInPandas(at_points, f"{entity} {dict(points.dtypes)[entity]}, us long, ln_hf double, ln_lf_hf double")


def parabolic_peak(before: Column, at: Column, after: Column) -> Column:
    """Offset of a parabola's vertex from the middle of three samples, within
    half a sample."""
    bend = before - 2 * at + after
    return F.when(bend == 0, 0.0).otherwise(F.least(F.greatest((before - after) / (2 * bend), F.lit(-0.5)), F.lit(0.5)))
