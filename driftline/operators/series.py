"""Windows over irregular series. A series has an entity column, ``us``
(microseconds, unique in its entity) and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..params import FeatureWindows
from .chunks import ROWS, Carried, carried, long_groups, widened

S = 1_000_000


Keys = str | list[str]


def along(entity: Keys = "entity", order: str = "us") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(order)


def trailing(width_s: float, entity: Keys = "entity", order: str = "us", closed: bool = True) -> WindowSpec:
    """[t - w, t], or (t - w, t] if not closed."""
    return along(entity, order).rangeBetween(-int(width_s * S) + (0 if closed else 1), 0)


def centred(width_s: float, entity: Keys = "entity", order: str = "us") -> WindowSpec:
    """[t - w/2, t + w/2]."""
    half = int(width_s * S / 2)
    return along(entity, order).rangeBetween(-half, half)


def trailing_sd(value: Column, w: WindowSpec) -> Column:
    """Sample standard deviation; null for fewer than two samples."""
    return F.stddev_samp(value).over(w)


def counted_mean(value: Column, w: WindowSpec, least: int) -> Column:
    """Mean, or null for fewer than ``least`` samples."""
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def ols_slope(value: Column, us: Column, w: WindowSpec, min_count: int, min_span_s: float, per_s: float = 60) -> Column:
    """Least-squares slope per ``per_s`` seconds; null for few samples or a
    short span."""
    span = F.max(us).over(w) - F.min(us).over(w)
    enough = (F.count(value).over(w) >= min_count) & (span > 0) & (span >= int(min_span_s * S))
    return F.when(enough, F.regr_slope(value, us.cast("double") / S).over(w) * per_s)


def features(df: DataFrame, rules: FeatureWindows = FeatureWindows(), entity: str = "entity", value: str = "value", rows: int = ROWS) -> DataFrame:
    """Adds sd, drop (short mean less base mean), slope and ready: causal
    features of each sample; ready rows have all of them and are past the
    warm-up. An entity of more than ``rows`` samples is taken in chunks that
    see as much as the widest window of what is before them."""
    v, us = F.col(value), F.col("us")

    def windows(by: list[str]) -> dict[str, Column]:
        short = counted_mean(v, trailing(rules.short_s, by), rules.min_short)
        base = counted_mean(v, trailing(rules.base_s, by), rules.min_base)
        slope = ols_slope(v, us, trailing(rules.slope_s, by), rules.min_slope, rules.min_slope_share * rules.slope_s)
        # whether the series began so long ago: some row lies there
        warm = F.min(us).over(Window.partitionBy(*by)) if by == [entity] else None
        return {"sd": trailing_sd(v, trailing(rules.spread_s, by)), "drop": short - base, "slope": slope} | ({"_first": warm} if warm is not None else {})

    widest = max(rules.spread_s, rules.short_s, rules.base_s, rules.slope_s)
    out = widened(df, windows, int(widest * S), by=[entity], rows=rows)
    if "_first" not in out.columns:  # cut series: the first time is one aggregate
        firsts = df.groupBy(F.col(entity).alias("_e")).agg(F.min("us").alias("_first"))
        out = out.join(firsts, F.col(entity).eqNullSafe(F.col("_e"))).drop("_e")
    ready = (us - F.col("_first") >= int(rules.warm_up_s * S)) & F.col("sd").isNotNull() & F.col("drop").isNotNull() & F.col("slope").isNotNull()
    return out.withColumn("ready", ready).drop("_first")


def sustained_min(value: Column, us: Column, hold_s: float, tolerance_s: float, entity: Keys = "entity") -> tuple[Column, Column]:
    """(least value over [t - hold, t], whether the samples span enough of it);
    the value itself for a hold of 0."""
    if hold_s == 0:
        return value, F.lit(True)
    w = trailing(hold_s, entity)
    return F.min(value).over(w), us - F.min(us).over(w) >= int((hold_s - tolerance_s) * S)


def record_highs(df: DataFrame, value: str = "value", entity: str = "entity", rows: int = ROWS) -> DataFrame:
    """Rows whose value is above all earlier ones of the entity."""
    top = carried(df, [entity], ["us"], {"_top": Carried("max", F.col(value))}, long_groups(df, [entity], "us", rows))
    return top.where(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def lag_gap(us: Column, entity: str = "entity") -> Column:
    """Seconds since the sample before."""
    return (us - F.lag(us).over(along(entity))).cast("double") / S


def changed(value: Column, entity: str = "entity") -> Column:
    """Whether the value differs from the one before; null in the first row."""
    return value != F.lag(value).over(along(entity))


def rising(flag: Column, entity: str = "entity", count_first: bool = False) -> Column:
    """Edges from false to true. The first row is an edge only if ``count_first``."""
    return flag & ~F.lag(flag, 1, not count_first).over(along(entity))


def runs(df: DataFrame, flag: Column, entity: str = "entity") -> DataFrame:
    """Maximal runs of rows with ``flag``: entity, start_us, end_us, n. A null
    flag is false."""
    w = along(entity)
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    numbered = marked.withColumn("_run", F.sum(F.when(~F.col("_on"), 1).otherwise(0)).over(w))
    on = numbered.where("_on")
    return on.groupBy(entity, "_run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n")).drop("_run")


def boxcar(value: Column, rows: int = 15, entity: str = "entity") -> Column:
    """Mean of the ``rows`` rows around, the first and last values repeated
    beyond the ends."""
    half = rows // 2
    w, all_rows = along(entity), along(entity).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = w.rowsBetween(-half, half)
    at, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(entity))
    below, above = F.greatest(half - (at - 1), F.lit(0)), F.greatest(half - (n - at), F.lit(0))
    total = F.sum(value).over(near) + below * F.first(value).over(all_rows) + above * F.last(value).over(all_rows)
    return total / rows


def gradient(value: Column, entity: str = "entity") -> Column:
    """Central differences, one-sided at the ends; null for a single row."""
    w = along(entity)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce((after - before) / 2, after - value, value - before)


def _collected(value: Column, w: WindowSpec) -> Column:
    return F.collect_list(value).over(w)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def lag1_autocorrelation(df: DataFrame, value: str, width_s: float, name: str, least: int = 6, entity: str = "entity") -> DataFrame:
    """Sum of products of neighbouring deviations over their squares, in the
    closed trailing window."""
    listed = df.withColumn("_x", _collected(F.col(value), trailing(width_s, entity)))
    centred_list = listed.withColumn("_d", F.transform("_x", lambda x: x - F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / F.size("_x")))
    d = F.col("_d")
    products = F.zip_with(F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), lambda a, b: a * b)
    squares = _sum(F.transform(d, lambda x: x * x))
    return centred_list.withColumn(name, F.when((F.size("_x") >= least) & (squares > 0), _sum(products) / squares)).drop("_x", "_d")


def reversal_rate(df: DataFrame, value: str, width_s: float, name: str, entity: str = "entity") -> DataFrame:
    """Share of sign changes among neighbouring differences that aren't 0."""
    listed = df.withColumn("_x", _collected(F.col(value), trailing(width_s, entity)))
    x = F.col("_x")
    n = F.greatest(F.size(x) - 1, F.lit(0))
    signs = listed.withColumn("_s", F.filter(F.zip_with(F.slice(x, 2, n), F.slice(x, 1, n), lambda a, b: F.signum(a - b)), lambda s: s != 0))
    s = F.col("_s")
    m = F.greatest(F.size(s) - 1, F.lit(0))
    flips = F.size(F.filter(F.zip_with(F.slice(s, 2, m), F.slice(s, 1, m), lambda a, b: a != b), lambda f: f))
    return signs.withColumn(name, F.when(F.size(s) >= 2, flips / (F.size(s) - 1))).drop("_x", "_s")


def quadratic(df: DataFrame, value: str, width_s: float, name: str, least: int = 6, scale_s: float = 60, entity: str = "entity") -> DataFrame:
    """Coefficient of the squared time, in units of ``scale_s``, of a
    least-squares parabola through the closed trailing window. Times are
    measured from the row itself, so sums stay small."""
    listed = df.withColumn("_p", F.collect_list(F.struct(F.col("us"), F.col(value).cast("double").alias("v"))).over(trailing(width_s, entity)))
    points = listed.withColumn("_p", F.transform("_p", lambda p: F.struct(((p.us - F.col("us")).cast("double") / S / scale_s).alias("x"), p.v.alias("v"))))

    def moments(p: Column) -> list[Column]:
        terms = [lambda q: q.x, lambda q: q.x * q.x, lambda q: q.x * q.x * q.x, lambda q: q.x * q.x * q.x * q.x, lambda q: q.v, lambda q: q.v * q.x, lambda q: q.v * q.x * q.x]
        return [_sum(F.transform(p, t)) for t in terms]

    p = F.col("_p")
    n = F.size(p).cast("double")
    sums = points.select("*", *[m.alias(f"_m{k}") for k, m in enumerate(moments(p))], n.alias("_n"))
    x1, x2, x3, x4, y0, y1, y2 = (F.col(f"_m{k}") for k in range(7))
    n = F.col("_n")
    # Cramer's rule on the normal equations
    det = n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2)
    top = n * (x2 * y2 - y1 * x3) - x1 * (x1 * y2 - y1 * x2) + y0 * (x1 * x3 - x2 * x2)
    fitted = F.when((n >= least) & (F.abs(det) > 1e-9), top / det)
    return sums.withColumn(name, fitted).drop("_p", "_n", *[f"_m{k}" for k in range(7)])


def z_normalized(value: Column, by: WindowSpec) -> Column:
    """(x - mean) / population SD; x - mean where the SD is 0."""
    sd, off = F.stddev_pop(value).over(by), value - F.avg(value).over(by)
    return F.when(sd > 0, off / sd).otherwise(off)


def ranked_quantile(df: DataFrame, value: str, p: float, name: str, by: list[str]) -> DataFrame:
    """The exclusive quantile, at position (n + 1) p, of each group; null for
    groups of one."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.row_number().over(w.orderBy(value)).alias("_k"), F.count("*").over(w).alias("_n"))
    at = F.least(F.greatest((F.col("_n") + 1) * p, F.lit(1.0)), F.col("_n").cast("double"))
    low = F.floor(at)
    picked = ranked.withColumn("_low", low).withColumn("_part", at - low).where((F.col("_k") == F.col("_low")) | (F.col("_k") == F.col("_low") + 1))
    weight = F.when(F.col("_k") == F.col("_low"), 1 - F.col("_part")).otherwise(F.col("_part"))
    return picked.groupBy(*by).agg(F.when(F.first("_n") >= 2, F.sum(F.col("_v") * weight)).alias(name))


def outer_quartiles(df: DataFrame, value: str, by: list[str], order: str = "us", least: int = 4) -> DataFrame:
    """(by, n, q1, q3): the exclusive quartiles of each group; of fewer than
    ``least`` values the first and the last one in time. Nulls don't count."""
    some = df.where(F.col(value).isNotNull())
    ends = some.groupBy(*by).agg(F.count("*").alias("n"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    low, high = (ranked_quantile(some, value, p, name, by) for p, name in ((0.25, "_q1"), (0.75, "_q3")))
    few = F.col("n") < least
    joined = ends.join(low, by).join(high, by)
    return joined.select(*by, "n", F.when(few, F.col("_first")).otherwise(F.col("_q1")).alias("q1"), F.when(few, F.col("_last")).otherwise(F.col("_q3")).alias("q3"))


def grids(df: DataFrame, step_s: float, values: list[str], entity: str = "entity", aligned: bool = False) -> DataFrame:
    """(entity, us, values) on a regular grid from each entity's first sample,
    or if ``aligned`` from the first whole multiple of the step, to its last,
    by linear interpolation."""
    step = int(step_s * S)
    w = along(entity)
    first_us = F.min("us").over(Window.partitionBy(entity))
    origin = F.ceil(first_us / step) * step if aligned else first_us
    here = {c: F.col(c).cast("double") for c in values}
    pieces = df.select(entity, "us", *[x.alias(f"_a_{c}") for c, x in here.items()], F.lead("us").over(w).alias("_us"), *[F.lead(x).over(w).alias(f"_b_{c}") for c, x in here.items()], origin.alias("_0"))
    first = F.ceil((F.col("us") - F.col("_0")) / step)
    last = F.when(F.col("_us").isNotNull(), F.ceil((F.col("_us") - F.col("_0")) / step) - 1).otherwise(first)
    # a gap without a grid point is empty; the last sample is a point only if it lies on the grid
    held = F.when(F.col("_us").isNull() & (first * step != F.col("us") - F.col("_0")), F.array().cast("array<bigint>")).when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    points = pieces.withColumn("_k", F.explode(held)).withColumn("_at", F.col("_0") + F.col("_k") * step)
    part = (F.col("_at") - F.col("us")) / (F.col("_us") - F.col("us"))
    between = lambda a, b: F.coalesce(a + (b - a) * part, a)
    return points.select(entity, F.col("_at").alias("us"), *[between(F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(c) for c in values])


def grid(df: DataFrame, step_s: float, value: str = "value", entity: str = "entity") -> DataFrame:
    """(entity, us, value) on a regular grid from each entity's first sample
    to its last, by linear interpolation."""
    return grids(df, step_s, [value], entity)


def first_true(df: DataFrame, flag: Column, name: str, entity: str = "entity") -> DataFrame:
    """(entity, name): the first time at which ``flag`` holds, or null."""
    return df.groupBy(entity).agg(F.min(F.when(flag, F.col("us"))).alias(name))
