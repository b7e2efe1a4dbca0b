"""Where a series and its spread fall fastest around onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import InflectionRules
from . import intervals, series
from .series import S


def smoothed_slopes(df: DataFrame, rules: InflectionRules = InflectionRules(), value: str = "value", spread: str = "sd", entity: str = "entity") -> DataFrame:
    """(entity, us, value, sd, d_value, d_sd) on the grid of whole multiples of
    the step: linear interpolation, the mean of ``smooth`` rows, and central
    differences of it. A missing spread counts as the entity's mean spread, or
    0 if there is none; samples without a value are left out."""
    mean = F.avg(spread).over(Window.partitionBy(entity))
    known = df.where(F.col(value).isNotNull()).select(F.col(entity).alias("entity"), "us", F.col(value).cast("double").alias("value"), F.coalesce(F.col(spread), mean, F.lit(0.0)).alias("sd"))
    points = series.grids(known, rules.step_s, ["value", "sd"], aligned=True)
    smooth = points.select("entity", "us", *[series.boxcar(F.col(c), rules.smooth).alias(c) for c in ("value", "sd")])
    return smooth.select("*", *[series.gradient(F.col(c)).alias(f"d_{c}") for c in ("value", "sd")])


def inflection_lags(slopes: DataFrame, onsets: DataFrame, rules: InflectionRules = InflectionRules()) -> DataFrame:
    """(entity, onset_us, value_us, sd_us, lag_s): for each onset (entity, us)
    the times of the steepest fall of the value and of its spread within
    ``half_s`` of it, the first of ties (slopes are compared to ``digits``
    places), and how much later that of the spread is. Onsets with less than
    ``share`` of their window on the grid are left out; onsets that repeat
    count once."""
    half = int(rules.half_s * S)
    spans = onsets.select("entity", F.col("us").alias("onset_us"), (F.col("us") - half).alias("start_us"), (F.col("us") + half).alias("end_us")).distinct()
    near = intervals.in_intervals(slopes.select("entity", "us", "d_value", "d_sd"), spans, width_s=2 * rules.half_s)
    steepest = {c: F.min(F.struct(F.round(f"d_{c}", rules.digits).alias("d"), "us")).alias(c) for c in ("value", "sd")}
    found = near.groupBy("entity", "onset_us").agg(F.count("*").alias("n"), *steepest.values())
    whole = found.where(F.col("n") >= int(2 * rules.half_s / rules.step_s * rules.share))
    at = {c: F.col(f"{c}.us") for c in steepest}
    return whole.select("entity", "onset_us", at["value"].alias("value_us"), at["sd"].alias("sd_us"), ((at["sd"] - at["value"]).cast("double") / S).alias("lag_s"))
