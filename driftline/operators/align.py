"""Alignment of mis-clocked label streams by offset search.

The offset grid has the step of the label epochs, so a shifted lookup is an
integer shift of the sample's epoch, and the sums at all shifts are a cross-
correlation of sums by epoch with two indicator series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fixed_text
from ..params import AlignmentRules, DensityGate
from ..shared import materialized
from . import stats


#: Label epochs of a chunk of the sweep.
CHUNK = 16_384


def _correlated(table: pa.Table, reach: int) -> pa.Table:
    """(entity, m, n_high, n_low, s_high, s_low) of one chunk: sums of sample
    epochs m after the label epochs of either kind, for all shifts at once by
    Fourier transforms. Counts are whole, so rounding makes them exact."""
    k = np.asarray(table.column("k"))
    label = np.asarray(table.column("kind")) > 0
    first = k[label].min() if label.any() else 0
    width = int(k[label].max() - first + 1) if label.any() else 0
    if not width or label.all():
        return pa.table({"entity": table.column("entity").slice(0, 0), **{c: pa.array([], t) for c, t in (("m", pa.int64()), ("n_high", pa.int64()), ("n_low", pa.int64()), ("s_high", pa.float64()), ("s_low", pa.float64()))}})
    # samples stand ``reach`` places further in than labels, so that shifts start at 0
    at = k - first + np.where(label, 0, reach)
    kept = (at >= 0) & (at < width + 2 * reach)
    size = 1 << int(width + 2 * reach).bit_length()
    kind, value, n = (np.asarray(table.column(c).to_numpy()) for c in ("kind", "s", "n"))

    def placed(rows: np.ndarray, amount: np.ndarray) -> np.ndarray:
        return np.fft.rfft(np.bincount(at[rows], amount[rows], size))

    middle = value[~label & kept].sum() / max(1, n[~label & kept].sum())  # values about 0 lose less to rounding
    counts, sums = placed(~label & kept, n.astype(float)), placed(~label & kept, value - middle * n)
    out = {}
    for name, code in (("high", 1), ("low", 2)):
        marks = np.conj(placed(label & ((kind & code) > 0), np.ones(len(k))))
        out[f"n_{name}"] = np.rint(np.fft.irfft(counts * marks, size)[: 2 * reach + 1]).astype(np.int64)
        out[f"s_{name}"] = np.fft.irfft(sums * marks, size)[: 2 * reach + 1] + middle * out[f"n_{name}"]
    met = np.flatnonzero((out["n_high"] > 0) | (out["n_low"] > 0))
    entity = table.column("entity").slice(0, 1).take(pa.array(np.zeros(len(met), np.int64)))
    return pa.table({"entity": entity, "m": met - reach, **{c: out[c][met] for c in ("n_high", "n_low", "s_high", "s_low")}})


def sweep(samples: DataFrame, labels: DataFrame, high: Column, low: Column, rules: AlignmentRules, entity: str = "entity") -> DataFrame:
    """(entity, m, n_high, n_low, separation) for each shift of ``m`` epochs
    that finds a label. ``samples``: (entity, k, value); ``labels``: (entity, k,
    label), unique; ``high`` and ``low`` are conditions on the label. Samples
    are summed by epoch and correlated with the labels in chunks of ``CHUNK``
    label epochs, whose sums add up; the separation is exact to rounding."""
    sums = samples.where(F.col(entity).isNotNull() & F.col("k").isNotNull()).groupBy(F.col(entity).alias("entity"), F.col("k").cast("long").alias("k")).agg(F.sum("value").cast("double").alias("s"), F.count("value").alias("n")).where("n > 0")
    near = F.sequence(F.floor((F.col("k") - rules.reach) / CHUNK), F.floor((F.col("k") + rules.reach) / CHUNK))
    seen = sums.select("entity", F.explode(near).alias("chunk"), "k", "s", "n", F.lit(0).alias("kind"))
    kind = F.when(high, 1).otherwise(0) + F.when(low, 2).otherwise(0)
    marked = labels.select(F.col(entity).alias("entity"), F.floor(F.col("k") / CHUNK).alias("chunk"), F.col("k").cast("long").alias("k"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), kind.alias("kind")).where("kind > 0 AND entity IS NOT NULL")
    schema = f"entity {dict(sums.dtypes)['entity']}, m long, n_high long, n_low long, s_high double, s_low double"
    reach = rules.reach
    parts = seen.unionByName(marked).groupBy("entity", "chunk").applyInArrow(lambda table: _correlated(table, reach), schema)
    counted = parts.groupBy("entity", "m").agg(*[F.sum(c).alias(c) for c in ("n_high", "n_low", "s_high", "s_low")])
    enough = (F.col("n_high") >= rules.min_samples) & (F.col("n_low") >= rules.min_samples)
    return counted.select(F.col("entity").alias(entity), "m", "n_high", "n_low", F.when(enough, F.col("s_high") / F.col("n_high") - F.col("s_low") / F.col("n_low")).alias("separation"))


def best_shift(swept: DataFrame, rules: AlignmentRules, entity: str = "entity") -> DataFrame:
    """(entity, best_m, best, at_zero, plateau_epochs): the first of the best
    shifts, and the span of all that come near to it, together or not."""
    w = Window.partitionBy(entity)
    order = w.orderBy(F.desc_nulls_last(F.round("separation", 9)), "m")  # equal but for rounding is equal
    top = swept.where("separation IS NOT NULL").withColumn("_best", F.max("separation").over(w)).withColumn("_k", F.row_number().over(order))
    near = F.col("separation") >= rules.plateau_share * F.col("_best")
    return top.groupBy(entity).agg(
        F.max(F.when(F.col("_k") == 1, F.col("m"))).alias("best_m"), F.max("_best").alias("best"), F.max(F.when(F.col("m") == 0, F.col("separation"))).alias("at_zero"),
        (F.max(F.when(near, F.col("m"))) - F.min(F.when(near, F.col("m")))).alias("plateau_epochs"),
    )


def alignment_table(samples: DataFrame, labels: DataFrame, high: Column, low: Column, rules: AlignmentRules, gate: DensityGate = DensityGate(), entity: str = "entity") -> DataFrame:
    """A row per entity of ``samples`` (entity, us, k, value; value null where
    it isn't known): its best shift, separation there and at 0, plateau, rate
    and median gap of the samples that lie within the shifted labels, the share
    of label epochs that they cover and of the covered span that is filled,
    onsets of the low label, all and covered, the first one's epoch, and whether
    it is usable, or why not. ``labels``: (entity, k, label), unique; epochs
    between the first and the last without a label are unknown."""
    samples, labels = materialized(samples.select(entity, "us", "k", "value"), "samples"), materialized(labels, "labels")
    known = samples.where("value IS NOT NULL")
    counts = samples.groupBy(entity).agg(F.count("value").alias("_known"))
    best = materialized(best_shift(sweep(known.select(entity, "k", "value"), labels, high, low, rules, entity), rules, entity), "best")
    spans = labels.groupBy(entity).agg(F.min("k").alias("_k0"), (F.max("k") - F.min("k") + 1).alias("n_epochs"))
    probed = best.join(counts.where(F.col("_known") >= rules.min_samples), entity).join(spans, entity)
    shifted = samples.join(probed.select(entity, "best_m", "_k0", "n_epochs"), entity).withColumn("_e", F.col("k") - F.col("best_m") - F.col("_k0")).where("_e >= 0 AND _e < n_epochs")
    rates = stats.cadence(shifted.select(entity, "us"), entity).select(entity, F.col("per_min").alias("in_rate"), F.col("median_gap_s").alias("in_gap_s"))
    covered = shifted.select(entity, "_e").distinct()
    cover = covered.groupBy(entity).agg(F.count("*").alias("_n"), (F.max("_e") - F.min("_e") + 1).alias("_span"))
    marked = labels.join(spans, entity).withColumn("_e", F.col("k") - F.col("_k0")).withColumn("_low", low).where("_low").select(entity, "_e")
    along = Window.partitionBy(entity).orderBy("_e")
    onsets = marked.withColumn("_before", F.lag("_e").over(along)).where("_e > 0 AND (_before IS NULL OR _before < _e - 1)").select(entity, "_e")
    held = covered.select(entity, "_e", F.lit(1).alias("_here"))
    twice = onsets.join(held, [entity, "_e"], "left").join(held.select(entity, (F.col("_e") + 1).alias("_e"), F.col("_here").alias("_prior")), [entity, "_e"], "left")
    onset_counts = twice.groupBy(entity).agg(F.count("*").alias("_onsets"), F.count(F.when(F.col("_here").isNotNull() & F.col("_prior").isNotNull(), 1)).alias("_covered"), F.min("_e").alias("_first"))
    joined = counts.join(probed.drop("_known"), entity, "left").join(rates, entity, "left").join(cover, entity, "left").join(onset_counts, entity, "left")
    seen, plateau_s = F.col("best_m").isNotNull(), F.col("plateau_epochs") * rules.epoch_s
    rate, gap = F.coalesce("in_rate", F.lit(0.0)), F.col("in_gap_s")
    far, wide = F.col("best") < rules.min_separation, plateau_s > rules.max_plateau_s
    sparse = (rate < gate.min_per_minute) | gap.isNull() | (gap > gate.max_median_gap_s)
    text = F.concat_ws(
        "; ",
        F.when(far, F.concat(F.lit("sep "), fixed_text(F.col("best"), 2), F.lit(f"<{rules.min_separation}"))),
        F.when(wide, F.concat(F.lit("plateau "), fixed_text(plateau_s.cast("double"), 0), F.lit(f"s>{rules.max_plateau_s:.0f}s"))),
        F.when(sparse, F.concat(F.lit("density rate="), fixed_text(rate, 1), F.lit("/min gap="), F.coalesce(fixed_text(gap, 1), F.lit("inf")), F.lit("s"))),
    )
    few = F.when(F.col("_known") < rules.min_samples, "too_few_HR_samples").otherwise("no_probe(insufficient N3/Wake coverage at any offset)")
    count = lambda c: F.when(seen, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return joined.select(
        entity, F.coalesce(seen & ~far & ~wide & ~sparse, F.lit(False)).alias("usable"), F.when(seen, text).otherwise(few).alias("reject"),
        "best_m", "best", "at_zero", plateau_s.alias("plateau_s"), F.when(seen, rate).otherwise(0.0).alias("in_rate"), "in_gap_s",
        F.coalesce(F.col("_n") / F.col("n_epochs"), F.lit(0.0)).alias("cover"), F.coalesce(F.col("_n") / F.col("_span"), F.lit(0.0)).alias("contiguity"),
        count("_onsets").alias("n_onsets"), count("_covered").alias("n_covered"), F.when(seen, F.coalesce("_first", F.lit(-1))).otherwise(-1).cast("long").alias("first_onset"),
    )


def verdict(table: DataFrame, rules: AlignmentRules, max_spread_s: float = 60) -> DataFrame:
    """One row: whether all clocks are clean, off by one constant, or each off
    by its own. Clean: all separations at 0 are positive, and the best ones are
    better by less than a tenth in the median. ``table``: best_m, best and
    at_zero of each entity."""
    some = materialized(table.where("best_m IS NOT NULL").select(F.lit(0).alias("g"), F.col("best_m").cast("double").alias("best_m"), "best", "at_zero", (F.col("best") - F.col("at_zero")).alias("gain")), "shifts")
    out = some.agg(
        F.count("*").alias("n"), F.count("at_zero").alias("n_zero"), F.coalesce(F.bool_and(F.col("at_zero") > 0), F.lit(True)).alias("all_positive"),
        (F.max("best_m") - F.min("best_m")).cast("long").alias("spread_epochs"),
    ).withColumn("g", F.lit(0))
    for c, name in (("at_zero", "median_zero"), ("gain", "median_gain"), ("best_m", "median_m")):
        out = out.join(stats.ranked_quantiles(some, c, {name: 0.5}, ["g"]), "g", "left")
    out = out.drop("g")
    clean = F.col("all_positive") & (F.col("median_gain") < 0.1 * F.abs(F.col("median_zero") + 1e-9))
    kind = F.when(F.col("n") == 0, "none").when(clean, "clean").when(F.col("spread_epochs") * rules.epoch_s <= max_spread_s, "constant").otherwise("per entity")
    return out.withColumn("verdict", kind)


def zone_check(table: DataFrame, epoch_s: float, hour_s: float = 3600, tolerance_s: float = 60) -> DataFrame:
    """One row (n, max_residual_s, zone): how far the best shifts are from whole
    hours at most, and whether a wrong time zone would explain them all.
    ``table``: best_m in epochs. Entities without a shift don't count; without
    any, both are null."""
    off = F.col("best_m") * F.lit(float(epoch_s))
    residual = F.abs(off - F.bround(off / hour_s) * hour_s)
    return table.agg(F.count("best_m").alias("n"), F.max(residual).alias("max_residual_s")).withColumn("zone", F.col("max_residual_s") <= tolerance_s)
