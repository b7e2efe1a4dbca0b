"""Summaries of groups: spreads, quantiles, cadence, bins, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fixed_text
from ..params import DensityGate
from ..shared import materialized
from . import spread
from .series import S, lag_gap


def five_numbers(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, lo, q1, med, q3, hi, mean, sd and iqr of each group; nulls don't count."""
    x = F.col(value).cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.min(x).alias("lo"), q.alias("_q"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    parts = [F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("q1", "med", "q3"))]
    return out.select(*(by or []), "n", "lo", *parts, "hi", "mean", "sd").withColumn("iqr", F.col("q3") - F.col("q1"))


def quantile(value: Column, p: float) -> Column:
    """Exact, by linear interpolation."""
    return F.percentile(value.cast("double"), F.lit(p))


def ranked_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    """(by, name, ...): exact quantiles by linear interpolation, of few and
    huge groups: ranks come from counts of distinct values and sums over parts
    of their range, so no task holds a group. Nulls don't count; a group
    without values has no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = materialized(counts.withColumn("_by", F.struct(*by).cast("string")), "values")
    ranked = spread.running(counts, "_by", spread.part_of(F.col("_v"), spread.splitters(counts, "_v")), ["_v"], F.col("_n"), "_before")
    totals = counts.groupBy("_by").agg(F.sum("_n").alias("_all"))
    rows = ranked.join(totals, "_by")
    at = {name: (F.col("_all") - 1) * float(p) for name, p in quantiles.items()}
    held = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))
    parts = [x for name, r in at.items() for x in (held(F.floor(r)).alias(f"{name}_low"), held(F.ceil(r)).alias(f"{name}_high"), F.max(r - F.floor(r)).alias(f"{name}_part"))]
    found = rows.groupBy(*by).agg(*parts)
    return found.select(*by, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in quantiles])


def distributions(df: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, n, least, p25, median, p75, most, mean, abs_median): how each
    column is distributed over all rows. Nulls don't count; a column without
    values has a row of nulls, with n 0."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("s")).select("s.*")
    long = materialized(long.withColumn("size", F.abs("x")), "measures")
    ends = long.groupBy("measure").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))
    quartiles = ranked_quantiles(long, "x", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["measure"])
    sizes = ranked_quantiles(long, "size", {"abs_median": 0.5}, ["measure"])
    out = ends.join(quartiles, "measure", "left").join(sizes, "measure", "left")
    return out.select("measure", "n", "least", "p25", "median", "p75", "most", "mean", "abs_median")


def ranked_values(counts: DataFrame) -> DataFrame:
    """(_v, _n, _before): how many rows have a smaller value, from counts of
    distinct values; written, and summed over parts of their range."""
    counts = materialized(counts.withColumn("_by", F.lit("")), "values")
    return spread.running(counts, "_by", spread.part_of(F.col("_v"), spread.splitters(counts, "_v")), ["_v"], F.col("_n"), "_before").drop("_by")


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def time_bins(df: DataFrame, width_s: float, fn: Column, name: str, entity: str = "entity", origin_us: Column | None = None) -> DataFrame:
    """(entity, b, name) for all bins from an origin, or else the entity's
    first sample, to its last one; empty bins have 0. A last sample that lies
    on a bin's end belongs to that bin."""
    w = int(width_s * S)
    whole = Window.partitionBy(entity)
    start = F.min("us").over(whole) if origin_us is None else origin_us
    last = F.ceil((F.max("us").over(whole) - start) / w) - 1
    placed = df.withColumn("b", F.least(F.floor((F.col("us") - start) / w), F.greatest(last, F.lit(0).cast("long"))))
    full = placed.groupBy(entity).agg(F.max("b").alias("_last")).select(entity, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("b"))
    return full.join(placed.groupBy(entity, "b").agg(fn.alias(name)), [entity, "b"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def bin_end_means(df: DataFrame, width_s: float, value: Column, entity: str = "entity") -> DataFrame:
    """(entity, end_us, mean): bins (end - width, end], the mean rounded half
    to even; empty bins have no row. A bin's values are summed in the order of
    time, one by one: a mean of just a half would otherwise be rounded by the
    error of whatever order its parts were summed in."""
    w = int(width_s * S)
    binned = df.select(entity, "us", value.alias("_v"), (F.ceil(F.col("us") / w) * w).alias("end_us"))
    in_order = Window.partitionBy(entity, "end_us").orderBy("us", "_v")
    running = F.avg("_v").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead(F.lit(True)).over(in_order).isNull()
    return binned.select(entity, "end_us", running.alias("_m"), last.alias("_last")).where("_last").select(entity, "end_us", F.bround("_m").alias("mean"))


def cadence(df: DataFrame, entity: str = "entity") -> DataFrame:
    """n, span_min, per_min, and the quantiles and mean of the gaps in seconds;
    with fewer than two samples the rate is 0 and gaps are null."""
    gaps = df.withColumn("_gap", lag_gap(F.col("us"), entity))
    q = F.percentile(F.col("_gap"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = gaps.groupBy(entity).agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")).cast("double") / S / 60).alias("span_min"), q.alias("_q"), F.avg("_gap").alias("mean_gap_s"))
    rate = F.when((F.col("n") >= 2) & (F.col("span_min") > 0), F.col("n") / F.col("span_min")).otherwise(0.0)
    return out.select(entity, "n", "span_min", rate.alias("per_min"), *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("p25_gap_s", "median_gap_s", "p75_gap_s"))], "mean_gap_s")


def density_gate(cadences: DataFrame, gate: DensityGate = DensityGate()) -> DataFrame:
    """Adds dense and reason: the first thing that makes a series too sparse to
    compute on, with its figures; empty for dense ones. Without a gap, a single
    sample's is infinite."""
    slow = F.col("per_min") < gate.min_per_minute
    gappy = F.col("median_gap_s").isNull() | (F.col("median_gap_s") > gate.max_median_gap_s)
    rate = F.concat(F.lit("rate "), fixed_text(F.col("per_min"), 2), F.lit(f"/min < {gate.min_per_minute:.1f}/min required"))
    gap = F.concat(F.lit("median gap "), F.coalesce(fixed_text(F.col("median_gap_s"), 1), F.lit("inf")), F.lit(f"s > {gate.max_median_gap_s:.0f}s required"))
    reason = F.when(slow, rate).when(gappy, gap).otherwise("")
    return cadences.withColumn("dense", ~slow & ~gappy).withColumn("reason", reason)


def within_group_spread(df: DataFrame, value: str, by: str, least: int = 2) -> DataFrame:
    """sd, half_range and max_dev (from the mean) of groups with enough rows."""
    x = F.col(value).cast("double")
    dev = F.abs(x - F.avg(x).over(Window.partitionBy(by)))
    return df.withColumn("_dev", dev).groupBy(by).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), ((F.max(x) - F.min(x)) / 2).alias("half_range"), F.max("_dev").alias("max_dev")).where(F.col("n") >= least)


def reason_tally(df: DataFrame, reason: str) -> DataFrame:
    """How often each first reason occurs, its numbers masked."""
    first = F.regexp_replace(F.trim(F.get(F.split(reason, ";"), F.lit(0))), "[0-9.]+", "#")
    return df.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))


def conditional_gap(df: DataFrame, value: str, high: Column, low: Column, least: int, by: list[str]) -> DataFrame:
    """Mean where ``high`` less mean where ``low``; null with fewer than
    ``least`` samples in either."""
    x = F.col(value)
    n_high, n_low = F.count(F.when(high, x)), F.count(F.when(low, x))
    gap = F.when((n_high >= least) & (n_low >= least), F.avg(F.when(high, x)) - F.avg(F.when(low, x)))
    return df.groupBy(*by).agg(n_high.alias("n_high"), n_low.alias("n_low"), gap.alias("separation"))


def coverage(df: DataFrame, entity: str = "entity", k: str = "k") -> DataFrame:
    """Distinct epochs, their span, and the share of it that they fill."""
    out = df.groupBy(entity).agg(F.countDistinct(k).alias("n_epochs"), (F.max(k) - F.min(k) + 1).alias("span_epochs"))
    return out.withColumn("contiguity", F.col("n_epochs") / F.col("span_epochs"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / float(width)).alias("bin")).agg(F.count("*").alias("n"))


def share_by_class(df: DataFrame, failed: Column, hard: Column, by: list[str]) -> DataFrame:
    """Share of failures that the hard class has, and its share of all rows."""
    n, fails = F.count("*"), F.sum(failed.cast("int"))
    return df.groupBy(*by).agg(n.alias("n"), F.coalesce(fails, F.lit(0)).cast("long").alias("fails"), F.try_divide(100.0 * F.sum((failed & hard).cast("int")), fails).alias("fail_share_pct"), (100.0 * F.sum(hard.cast("int")) / n).alias("row_share_pct"))


def top_days(df: DataFrame, k: int, entity: str = "entity") -> DataFrame:
    """The ``k`` days with the most samples and the median of their values;
    the earlier of days with as many."""
    day = F.floor(F.col("us") / (86_400 * S))
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.percentile(F.col("value"), F.lit(0.5)).alias("median_value")).orderBy(F.desc("n"), "day").limit(k)
