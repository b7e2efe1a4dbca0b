"""Series along sessions, measured from each session's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .medians import sliding_median
from .series import S, centred


def _minutes(us: Column) -> Column:
    return us.cast("double") / S / 60


def rolling_along(points: DataFrame, width_s: float, by: str) -> DataFrame:
    """(by, at_min, value, median, sd): samples (by, start_us, us, value) with
    the median and the population SD of the centred window, of samples of the
    same session only. Null values don't count in a window."""
    half = int(width_s * S / 2)
    spreads = points.select(by, "start_us", "us", F.col("value").cast("double").alias("value")).withColumn("sd", F.stddev_pop("value").over(centred(width_s, by)))
    found = sliding_median(spreads, "median", half, half, entity=by)
    return found.select(by, _minutes(F.col("us") - F.col("start_us")).alias("at_min"), "value", "median", "sd")


def binned_rms(points: DataFrame, bin_s: float, gravity_s: float, by: str) -> DataFrame:
    """(by, at_min, rms): the root mean square, in bins from the session's start
    to its last sample, of what is left of the value without its centred sliding
    median; at_min is a bin's middle. A last sample that lies on a bin's end
    belongs to that bin; empty bins are 0; null values are left out."""
    half, w = int(gravity_s * S / 2), int(bin_s * S)
    known = points.where(F.col("value").isNotNull()).select(by, "start_us", "us", F.col("value").cast("double").alias("value"))
    bins = F.ceil((F.max("us").over(Window.partitionBy(by)) - F.col("start_us")) / w)
    rest = sliding_median(known.withColumn("bins", bins), "gravity", half, half, entity=by).where("bins > 0")
    own = F.least(F.floor((F.col("us") - F.col("start_us")) / w), F.col("bins") - 1)
    off = F.col("value") - F.col("gravity")
    filled = rest.groupBy(by, own.alias("bin")).agg(F.sqrt(F.avg(off * off)).alias("rms"))
    every = known.groupBy(by, "start_us").agg(F.max("us").alias("last")).select(by, F.ceil((F.col("last") - F.col("start_us")) / w).alias("bins")).where("bins > 0")
    every = every.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every.join(filled, [by, "bin"], "left").select(by, ((F.col("bin") + 0.5) * bin_s / 60).alias("at_min"), F.coalesce("rms", F.lit(0.0)).alias("rms"))
