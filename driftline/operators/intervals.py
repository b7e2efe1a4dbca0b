"""Intervals [start_us, end_us) with labels: union, merging, sessions, clipping
and matching. Joins on ranges are equi-joins on time buckets, so that no
entity's rows meet all of another table's; scans along time go in chunks where
an entity is long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ROWS, Carried, carried, long_groups
from .series import S


ORDER = ["start_us", "end_us"]


def islands(df: DataFrame, by: list[str], gap_s: float = 0.0, strict: bool = False, rows: int = ROWS) -> DataFrame:
    """Adds ``island``: intervals of a group chain on while the next start is
    at most ``gap_s`` after the greatest end so far (below it, if ``strict``).
    A group of more than ``rows`` intervals is scanned in chunks."""
    return _islands(df, by, gap_s, strict, long_groups(df, by, "start_us", rows))


def _islands(df: DataFrame, by: list[str], gap_s: float, strict: bool, cuts: DataFrame | None) -> DataFrame:
    reached = carried(df, by, ORDER, {"_reached": Carried("max", F.col("end_us"))}, cuts)
    gap = F.col("start_us") - F.col("_reached")
    limit = int(gap_s * S)
    new = (gap >= limit) if strict else (gap > limit)
    flagged = reached.withColumn("_new", F.when(F.col("_reached").isNull() | new, 1).otherwise(0)).withColumn("_flip", -F.col("_new"))
    # of intervals that tie, the one that begins an island comes first; within one sort that is so anyway
    order = ORDER if cuts is None else [*ORDER, "_flip"]
    return carried(flagged, by, order, {"island": Carried("sum", F.col("_new"), edge=0)}, cuts).drop("_reached", "_new", "_flip")


def merged(df: DataFrame, by: list[str], gap_s: float = 0.0, rows: int = ROWS) -> DataFrame:
    """One interval for each island: by, start_us, end_us, n."""
    return islands(df, by, gap_s, rows=rows).groupBy(*by, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("island")


def merged_in_order(df: DataFrame, label: str, gap_s: float, entity: str = "entity", rows: int = ROWS) -> DataFrame:
    """Neighbours in time, of any label, are merged only if they have one label
    and lie close: entity, label, start_us, end_us, n."""
    cuts = long_groups(df, [entity], "start_us", rows)
    order = [*ORDER, label]
    before = carried(df, [entity], order, {"_before": Carried("last", F.struct(F.col(label).alias("label"), "end_us"))}, cuts)
    joins = (F.col(label) == F.col("_before.label")) & (F.col("start_us") - F.col("_before.end_us") <= int(gap_s * S))
    flagged = before.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_flip", -F.col("_new"))
    numbered = carried(flagged, [entity], order if cuts is None else [*order, "_flip"], {"_run": Carried("sum", F.col("_new"), edge=0)}, cuts)
    return numbered.groupBy(entity, "_run", label).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("_run")


def fresh_time(df: DataFrame, by: list[str], name: str, cuts: DataFrame | None) -> DataFrame:
    """Adds ``name``: microseconds of each interval that no earlier one of its
    group covers; their sum is what the group covers."""
    reached = carried(df, by, ORDER, {"_reached": Carried("max", F.col("end_us"))}, cuts)
    return reached.withColumn(name, F.greatest(F.col("end_us") - F.greatest("start_us", "_reached"), F.lit(0))).drop("_reached")


def minutes(us: Column) -> Column:
    return us.cast("double") / S / 60


def union_minutes(df: DataFrame, by: list[str], rows: int = ROWS) -> DataFrame:
    """(by, minutes): time that the intervals of a group cover."""
    return fresh_time(df, by, "_fresh", long_groups(df, by, "start_us", rows)).groupBy(*by).agg(minutes(F.sum("_fresh")).alias("minutes"))


def session_summary(df: DataFrame, labels: list[str], asleep: list[str], gap_s: float, entity: str = "entity", label: str = "label", source: str = "source", rows: int = ROWS) -> DataFrame:
    """A row per session: its bounds, the minutes that each label covers (0 if
    none), minutes asleep, efficiency in percent, sources and records. All
    windows lie within an entity, so rows move once; an entity of more than
    ``rows`` intervals is scanned in chunks."""
    cuts = long_groups(df, [entity], "start_us", rows)
    keyed = _islands(df, [entity], gap_s, False, cuts).withColumnRenamed("island", "session")
    by = [entity, "session"]
    rested = keyed.withColumn("_rest", F.col(label).isin(asleep))
    # a part of an entity that isn't long isn't long
    inner = lambda table, keys: None if cuts is None else long_groups(table, keys, "start_us", rows)
    timed = fresh_time(rested, [*by, label], "_own", inner(rested, [*by, label]))
    timed = fresh_time(timed, [*by, "_rest"], "_slept", inner(rested, [*by, "_rest"])).withColumn("_slept", F.when(F.col("_rest"), F.col("_slept")))
    per_label = [minutes(F.coalesce(F.sum(F.when(F.col(label) == x, F.col("_own"))), F.lit(0))).alias(f"{x}_min") for x in labels]
    out = timed.groupBy(*by).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("records"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"),
        minutes(F.max("end_us") - F.min("start_us")).alias("duration_min"), *per_label, minutes(F.coalesce(F.sum("_slept"), F.lit(0))).alias("asleep_min"),
    )
    return out.withColumn("efficiency_pct", F.when(F.col("duration_min") > 0, 100 * F.col("asleep_min") / F.col("duration_min")))


def bucketed(df: DataFrame, start: Column, end: Column, width_s: float) -> DataFrame:
    """A row per time bucket that the interval touches, in ``bucket``."""
    w = int(width_s * S)
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(start / w), F.floor(F.greatest(start, end) / w))))


def in_intervals(points: DataFrame, spans: DataFrame, entity: str = "entity", width_s: float = 86_400, how: str = "inner", half_open: bool = False) -> DataFrame:
    """Points ``us`` that lie in an interval of their entity, ends included
    unless ``half_open``; with ``inner`` one row per pair, with the interval's
    columns."""
    p = points.withColumn("bucket", F.floor(F.col("us") / int(width_s * S))).alias("p")
    s = bucketed(spans, F.col("start_us"), F.col("end_us"), width_s).alias("s")
    before = "p.us < s.end_us" if half_open else "p.us <= s.end_us"
    on = F.expr(f"p.{entity} = s.{entity} AND p.bucket = s.bucket AND p.us >= s.start_us AND {before}")
    joined = p.join(s, on, "left_semi" if how == "semi" else how)
    if how == "semi":
        return joined.drop("bucket")
    return joined.select("p.*", *[F.col(f"s.{c}") for c in spans.columns if c != entity]).drop("bucket")


def overlaps(left: DataFrame, right: DataFrame, entity: str = "entity", width_s: float = 86_400) -> DataFrame:
    """Pairs of intervals of one entity that overlap, each pair once: the
    columns of left as l_*, of right as r_*, and overlap_us."""
    a, b = (bucketed(df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns]), F.col(f"{p}_start_us"), F.col(f"{p}_end_us"), width_s) for df, p in ((left, "l"), (right, "r")))
    w = int(width_s * S)
    low, high = F.greatest("l_start_us", "r_start_us"), F.least("l_end_us", "r_end_us")
    pairs = a.join(b, (F.col(f"l_{entity}") == F.col(f"r_{entity}")) & (a["bucket"] == b["bucket"])).where((low < high) & (F.floor(low / w) == a["bucket"]))
    return pairs.drop("bucket").withColumn("overlap_us", high - low)


def best_overlap(left: DataFrame, right: DataFrame, left_id: str, order: str, entity: str = "entity", width_s: float = 86_400) -> DataFrame:
    """For each left interval with an overlap the right one that it shares the
    most with, the first by ``order`` among equals."""
    w = Window.partitionBy(f"l_{left_id}").orderBy(F.desc("overlap_us"), f"r_{order}")
    return overlaps(left, right, entity, width_s).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def nearest_by_gap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, entity: str = "entity") -> DataFrame:
    """(left_id, right_id, gap_us): for each left interval the right one with
    the smallest gap, 0 where they touch or overlap. Candidates are, of those
    that start no later, the one that ends last, and the first that starts
    later; the former of two as near. One pass along time."""
    side = lambda df, at, kind, i: df.select(entity, F.col(at).alias("us"), F.lit(kind).alias("_kind"), F.struct(F.col("start_us").alias("s"), F.col(i).alias("i"), F.col("end_us").alias("e")).alias("_x"))
    rows = side(right, "start_us", 0, right_id).unionByName(side(left, "start_us", 1, left_id))
    w = Window.partitionBy(entity).orderBy("us")
    back, on = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    started = F.when(F.col("_kind") == 0, F.struct(F.col("_x.e").alias("e"), (-F.col("_x.s")).alias("s"), (-F.col("_x.i")).alias("i")))
    # of those that started before, the one that reaches furthest; of those that start after, the first
    found = rows.withColumn("_b", F.max(started).over(back)).withColumn("_a", F.min(F.when(F.col("_kind") == 0, F.col("_x"))).over(on)).where("_kind = 1")
    start, end = F.col("_x.s"), F.col("_x.e")
    gap_b, gap_a = F.greatest(start - F.col("_b.e"), F.lit(0)), F.greatest(F.col("_a.s") - end, F.lit(0))
    picked = F.array_min(F.array_compact(F.array(F.when(F.col("_b").isNotNull(), F.struct(gap_b.alias("gap"), (-F.col("_b.s")).alias("s"), (-F.col("_b.i")).alias("i"))), F.when(F.col("_a").isNotNull(), F.struct(gap_a.alias("gap"), F.col("_a.s").alias("s"), F.col("_a.i").alias("i"))))))
    return found.withColumn("_p", picked).where("_p IS NOT NULL").select(F.col("_x.i").alias(left_id), F.col("_p.i").alias(right_id), F.col("_p.gap").alias("gap_us"))


def last_ended(left: DataFrame, right: DataFrame, left_id: str, right_id: str, entity: str = "entity") -> DataFrame:
    """(left_id, right_id, gap_us): the right interval that ended last before
    or when the left one starts; of several, the greatest id. One pass over
    both tables."""
    starts = left.select(entity, F.col("start_us").alias("us"), F.col(left_id).alias("_l"), F.lit(None).cast("long").alias("_r"))
    stops = right.select(entity, F.col("end_us").alias("us"), F.lit(None).cast("long").alias("_l"), F.col(right_id).alias("_r"))
    ended = F.max(F.when(F.col("_r").isNotNull(), F.struct("us", "_r"))).over(Window.partitionBy(entity).orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    found = starts.unionByName(stops).withColumn("_e", ended).where("_l IS NOT NULL AND _e IS NOT NULL")
    return found.select(F.col("_l").alias(left_id), F.col("_e._r").alias(right_id), (F.col("us") - F.col("_e.us")).alias("gap_us"))


def clipped(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals cut to the window [start, end]; ``outside`` if nothing is in it."""
    gone = (F.col("end_us") <= start) | (F.col("start_us") >= end)
    return df.withColumn("outside", gone).withColumn("clip_start_us", F.when(~gone, F.greatest("start_us", start))).withColumn("clip_end_us", F.when(~gone, F.least("end_us", end)))


def clip_statistics(df: DataFrame, start: Column, end: Column, by: list[str]) -> DataFrame:
    """(by, kept, before_us, after_us, outside): how much of a group's intervals
    lies before and after the window, and how many lie outside of it."""
    gone = (F.col("end_us") <= start) | (F.col("start_us") >= end)
    cut = lambda x: F.coalesce(F.sum(F.when(~gone, F.greatest(x, F.lit(0)))), F.lit(0)).alias
    return df.groupBy(*by).agg(F.count(F.when(~gone, 1)).alias("kept"), cut(start - F.col("start_us"))("before_us"), cut(F.col("end_us") - end)("after_us"), F.count(F.when(gone, 1)).alias("outside"))


def epochs_in(df: DataFrame, epoch_s: float, entity: str = "entity") -> DataFrame:
    """(entity, k) of the epochs, counted from 1970, whose midpoint lies in an
    interval [start, end); each once."""
    step = int(epoch_s * S)
    first = F.ceil((F.col("start_us") - step // 2) / step)
    last = F.ceil((F.col("end_us") - step // 2) / step) - 1
    return df.where(last >= first).select(entity, F.explode(F.sequence(first, last)).alias("k")).distinct()


def epochs_to_intervals(df: DataFrame, epoch_s: float, origin_us: Column, k: str = "k") -> DataFrame:
    step = int(epoch_s * S)
    return df.withColumn("start_us", origin_us + F.col(k) * step).withColumn("end_us", F.col("start_us") + step)
