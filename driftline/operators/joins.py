"""Lookups along time: next and nearest events, labels by epoch, parameter grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ROWS, Carried, carried, long_groups
from .series import S


def next_event(df: DataFrame, is_event: Column, name: str = "tau", entity: str = "entity", rows: int = ROWS) -> DataFrame:
    """Adds seconds to the entity's next event strictly after the row; null if
    there is none. Samples and events are rows of one table; an entity of more
    than ``rows`` of them is scanned in chunks."""
    found = carried(df, [entity], ["us"], {"_next": Carried("min", F.when(is_event, F.col("us")), 1, True, True)}, long_groups(df, [entity], "us", rows))
    return found.withColumn(name, (F.col("_next") - F.col("us")).cast("double") / S).drop("_next")


def next_event_of(samples: DataFrame, events: DataFrame, name: str = "tau", entity: str = "entity") -> DataFrame:
    """The same, with the events (entity, us) in a table of their own."""
    both = samples.withColumn("_event", F.lit(False)).unionByName(events.select(entity, "us").withColumn("_event", F.lit(True)), allowMissingColumns=True)
    return next_event(both, F.col("_event"), name, entity).where("NOT _event").drop("_event")


def nearest_event(samples: DataFrame, events: DataFrame, name: str = "near_us", entity: str = "entity", rows: int = ROWS) -> DataFrame:
    """Adds the time of the event nearest to each sample; of two as near, the
    earlier; null if the entity has none."""
    both = samples.withColumn("_event", F.lit(None).cast("long")).unionByName(events.select(entity, "us").withColumn("_event", F.col("us")), allowMissingColumns=True).withColumn("_is", F.col("_event").isNotNull())
    event = F.col("_event")
    found = carried(both, [entity], ["us"], {"_b": Carried("max", event, 0, False, True), "_a": Carried("min", event, 0, True, True)}, long_groups(both, [entity], "us", rows)).where("NOT _is")
    near = F.when(F.col("_b").isNull() | (F.col("_a") - F.col("us") < F.col("us") - F.col("_b")), F.coalesce("_a", "_b")).otherwise(F.col("_b"))
    return found.withColumn(name, near).drop("_event", "_is", "_b", "_a")


def at_epoch(samples: DataFrame, labels: DataFrame, k: Column, entity: str = "entity", how: str = "inner") -> DataFrame:
    """Samples with the label of their epoch; ``labels``: (entity, k, label)."""
    return samples.withColumn("k", k).join(labels, [entity, "k"], how)


def coincidences(events: DataFrame, bins: DataFrame, level: Column, around_s: float, entity: str = "entity") -> DataFrame:
    """Events with a bin (entity, us, value) within ``around_s`` whose greatest
    value is at least ``level``: the columns of events and peak."""
    width = int(2 * around_s * S)
    e = events.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("us") - int(around_s * S)) / width), F.floor((F.col("us") + int(around_s * S)) / width))))
    b = bins.select(entity, F.col("us").alias("_us"), F.col("value").alias("_v"), F.floor(F.col("us") / width).alias("bucket"))
    near = e.join(b, [entity, "bucket"]).where(F.abs(F.col("_us") - F.col("us")) <= int(around_s * S))
    return near.groupBy(*events.columns).agg(F.max("_v").alias("peak")).where(F.col("peak") >= level)


def parameter_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Every combination of some values; one column for each name. As large as
    its arguments say, so joins with it may be broadcast."""
    out = None
    for name, options in values.items():
        one = spark.createDataFrame([(x,) for x in options], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def lost_groups(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Groups with no row left."""
    return before.select(*by).distinct().join(after.select(*by).distinct(), by, "left_anti")


def with_both_epochs(onsets: DataFrame, covered: DataFrame, entity: str = "entity") -> DataFrame:
    """Onsets (entity, k) whose epoch and the one before are covered."""
    here = onsets.join(covered.select(entity, "k").distinct(), [entity, "k"], "left_semi")
    return here.withColumn("k", F.col("k") - 1).join(covered.select(entity, "k").distinct(), [entity, "k"], "left_semi").withColumn("k", F.col("k") + 1)
