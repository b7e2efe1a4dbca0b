"""Beats of an electrocardiogram, and a recording's way from samples to rates.

Peaks are found in numpy over chunks with halos. Every step looks at a bounded
neighbourhood, counted from the recording's first sample, so a chunk finds
what the whole recording would: the signal less its moving mean is smoothed;
the moving mean of the squared slope is the energy; a candidate has the
greatest energy within the refractory time and at least a share of the median
of the block maxima around; the beat is the greatest deflection next to it,
refined by a parabola.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import BeatRules
from . import beats
from .chunks import ROWS, Carried, carried, long_groups
from .stats import bin_end_means


@dataclass(frozen=True)
class PeakRules:
    #: Widths in seconds.
    baseline_s: float = 0.6
    smooth_s: float = 0.02
    energy_s: float = 0.12
    refractory_s: float = 0.25
    around_s: float = 0.08
    #: Blocks whose greatest energies set the threshold: so many on each side.
    block_s: float = 1.0
    blocks: int = 4
    share: float = 0.3
    #: Seconds of a chunk.
    chunk_s: float = 600


def box(x: np.ndarray, width: int) -> np.ndarray:
    """Moving mean over an odd number of samples, the ends repeated."""
    width = max(1, width) | 1
    if width == 1:
        return x
    return np.convolve(np.pad(x, width // 2, mode="edge"), np.full(width, 1 / width), "valid")


def found_peaks(x: np.ndarray, rate: float, first: int, rules: PeakRules) -> np.ndarray:
    """Places of the beats in ``x``, whose first sample is the recording's
    ``first``-th, in fractions of samples from the recording's start."""
    n, block = len(x), max(1, round(rules.block_s * rate))
    if n < 3:
        return np.empty(0)
    y = box(x - box(x, round(rules.baseline_s * rate)), round(rules.smooth_s * rate))
    slope = np.zeros(n)
    slope[1:-1] = y[2:] - y[:-2]
    energy = box(slope * slope, round(rules.energy_s * rate))
    # maxima of blocks that are counted from the recording's start
    own = (np.arange(n) + first) // block
    starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
    top = np.pad(np.maximum.reduceat(energy, starts), rules.blocks, constant_values=np.nan)
    limit = rules.share * np.nanmedian(sliding_window_view(top, 2 * rules.blocks + 1), axis=1)
    r = max(1, round(rules.refractory_s * rate))
    padded = np.pad(energy, r, constant_values=-1.0)
    windows = sliding_window_view(padded, r)
    before, after = windows[:n].max(1), windows[r + 1 : r + 1 + n].max(1)
    candidates = np.flatnonzero((energy > before) & (energy >= after) & (energy > 0) & (energy >= limit[own - own[0]]))
    reach = max(1, round(rules.around_s * rate))
    out = []
    for c in candidates:
        a, b = max(0, c - reach), min(n, c + reach + 1)
        k = a + int(np.argmax(np.abs(y[a:b])))
        bend = y[k - 1] - 2 * y[k] + y[k + 1] if 0 < k < n - 1 else 0.0
        out.append(first + k + (min(0.5, max(-0.5, (y[k - 1] - y[k + 1]) / (2 * bend))) if bend else 0.0))
    return np.unique(np.array(out))


def lead(signals: DataFrame) -> DataFrame:
    """(file, rate, record, per_record, samples): of each recording the
    difference of two leads, if its cardiac signals are ECG1 and ECG2, else the
    first of them. ``signals`` are rows of the ``edf`` source."""
    cardiac = signals.where(F.col("label").rlike("(?i)(ecg|ekg)"))
    listed = F.array_sort(F.collect_list(F.struct("signal", F.upper("label").alias("label"), "rate", "samples")))
    rows = cardiac.groupBy("file", "record").agg(listed.alias("s"))  # a row a signal
    s, one, two = F.col("s"), F.col("s")[0], F.get("s", F.lit(1))
    apart = (F.size(s) == 2) & F.array_contains(F.transform(s, lambda x: x.label), "ECG1") & F.array_contains(F.transform(s, lambda x: x.label), "ECG2") & (F.size(one.samples) == F.size(two.samples))
    samples = F.when(apart, F.zip_with(one.samples, two.samples, lambda a, b: a - b)).otherwise(one.samples)
    return rows.select("file", one.rate.alias("rate"), "record", F.size(samples).alias("per_record"), samples.alias("samples"))


def peaks(leads: DataFrame, rules: PeakRules = PeakRules()) -> DataFrame:
    """(file, us): the beats of each recording, in microseconds from its start.
    ``leads``: rows of ``lead``. Recordings shorter than three samples have
    none. A task holds a chunk of a recording and its halo."""
    halo = (rules.blocks + 1) * rules.block_s + rules.baseline_s + 2 * rules.refractory_s
    # whole blocks, so that chunks begin where blocks do
    block = F.greatest(F.lit(1), F.round(F.lit(rules.block_s) * F.col("rate"))).cast("long")
    size = block * max(1, round(rules.chunk_s / rules.block_s))
    edge = block * int(np.ceil(halo / rules.block_s))
    at = F.col("record") * F.col("per_record")
    low, high = F.greatest(F.lit(0).cast("long"), F.floor((at - edge) / size)), F.floor((at + F.col("per_record") - 1 + edge) / size)
    dealt = leads.select("file", "rate", at.alias("at"), "samples", size.alias("size"), edge.alias("edge"), F.explode(F.sequence(low, high)).alias("chunk"))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first, rate, size, chunk, edge = (rows[c].iloc[0] for c in ("at", "rate", "size", "chunk", "edge"))
        x = np.concatenate(rows["samples"].to_list()).astype(float)
        # exactly the halo, whatever records its ends lie in
        cut = max(0, chunk * size - edge - first)
        stop = min(len(x), (chunk + 1) * size + edge - first)
        place = found_peaks(x[cut:stop], rate, int(first + cut), rules)
        mine = place[np.floor(place + 0.5).astype(int) // size == chunk]
        return pd.DataFrame({"file": pd.Series([rows["file"].iloc[0]] * len(mine), dtype=object), "us": np.round(mine / rate * 1e6).astype(np.int64)})

    return dealt.groupBy("file", "chunk").applyInPandas(found, "file string, us long")


def intervals_of(found: DataFrame, rules: BeatRules = BeatRules(), entity: str = "file", rows: int = ROWS) -> DataFrame:
    """(entity, us, rr, i, keep): the time since the beat before, at the later
    beat, judged by ``beats.ectopic_filter``."""
    before = carried(found, [entity], ["us"], {"_b": Carried("max", F.col("us"))}, long_groups(found, [entity], "us", rows))
    rr = before.where("_b IS NOT NULL").select(entity, "us", ((F.col("us") - F.col("_b")) / 1e3).alias("rr"))
    numbered = rr.withColumn("i", F.row_number().over(Window.partitionBy(entity).orderBy("us")))
    return beats.ectopic_filter(numbered, rules, entity)


def inside(labels: DataFrame, durations: DataFrame, epoch_s: float) -> DataFrame:
    """Label epochs (file, us, stage) that lie wholly within their recording."""
    end = F.col("us") + int(epoch_s * 1e6)
    return labels.join(durations.select("file", "duration_us"), "file").where((F.col("us") >= 0) & (end <= F.col("duration_us"))).drop("duration_us")


def ingest(leads: DataFrame, labels: DataFrame, found: DataFrame, judged: DataFrame, epoch_s: float = 30, bin_s: float = 5, deep: int = 3, most_removed: float = 0.20) -> tuple[DataFrame, DataFrame]:
    """Rates (file, end_us, mean) in bins of kept beats, and a row for each
    recording: rate, hours, n_beats, the percentages of intervals that were
    removed within the labelled time and in all, whether the former is too
    much, label epochs, how many were trimmed, onsets of the deep stage, bins,
    and medians. ``leads``, ``found`` (beats) and ``judged`` (intervals) are
    read more than once, so they should be written tables."""
    spans = leads.groupBy("file").agg(F.first("rate").alias("fs"), F.sum("per_record").alias("n"))
    durations = spans.withColumn("duration_us", (F.col("n") / F.col("fs") * 1e6).cast("long"))
    trimmed = inside(labels, durations, epoch_s)
    step = int(epoch_s * 1e6)
    along = Window.partitionBy("file").orderBy("us")
    onset = (F.col("stage") == deep) & (F.lag("stage").over(along) != deep)
    epochs = trimmed.withColumn("onset", onset).groupBy("file").agg(F.count("*").alias("epochs"), F.count(F.when(F.col("onset"), 1)).alias("onsets"), F.min("us").alias("from_us"), (F.max("us") + step).alias("to_us"))
    every = labels.groupBy("file").agg(F.count("*").alias("all_epochs"))
    gone = F.when(F.col("keep"), 0.0).otherwise(1.0)
    scored = (F.col("us") >= F.col("from_us")) & (F.col("us") < F.col("to_us"))
    removed = judged.join(epochs, "file", "left").groupBy("file").agg(F.avg(gone).alias("all_removed"), F.avg(F.when(scored, gone)).alias("scored_removed"), F.percentile(F.when(F.col("keep"), F.col("rr")), F.lit(0.5)).alias("median_rr_ms"))
    within = judged.where("keep").join(durations.select("file", "duration_us"), "file").withColumn("rate", 60_000 / F.col("rr"))
    whole_bins = F.floor(F.col("duration_us") / int(bin_s * 1e6)) * int(bin_s * 1e6)
    rates = bin_end_means(within.where(F.col("us") <= whole_bins), bin_s, F.col("rate"), "file")
    bins = rates.groupBy("file").agg(F.count("*").alias("bins"), F.percentile("mean", F.lit(0.5)).alias("median_rate"))
    counted = found.groupBy("file").agg(F.count("*").alias("n_beats"))
    out = durations.join(counted, "file", "left").join(every, "file", "left").join(epochs, "file", "left").join(removed, "file", "left").join(bins, "file", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rates, out.select(
        "file", "fs", F.round(F.col("duration_us") / 3.6e9, 2).alias("hours"), count("n_beats").alias("n_beats"), F.round(100 * F.col("scored_removed"), 2).alias("pct_removed_scored"), F.round(100 * F.col("all_removed"), 2).alias("pct_removed_all"),
        F.coalesce(F.col("scored_removed") > most_removed, F.lit(False)).alias("excluded"), count("epochs").alias("epochs"), (count("all_epochs") - count("epochs")).alias("epochs_trimmed"), count("onsets").alias("deep_onsets"), count("bins").alias("hr_bins"), "median_rate", "median_rr_ms",
    )
