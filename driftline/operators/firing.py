"""Firing rules on scored series: when a threshold is first crossed, how that
compares with the onset of the event, and surfaces of both over grids of
rules. Grids are parameters; a pass over the series serves all of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import FiringRules
from .series import S, sustained_min
from .stats import ranked_quantiles, ranked_values


def held_scores(df: DataFrame, sustains_s: list[float], tolerance_s: float, score: str = "score", entity: str = "entity") -> DataFrame:
    """(sustain_s, entity, us, high): for each sustain the score that has been
    held so long; rows whose window spans too little are left out."""
    each = []
    for s in sustains_s:
        held, ok = sustained_min(F.col(score), F.col("us"), s, tolerance_s, entity)
        each.append(F.struct(F.lit(s).alias("sustain_s"), held.alias("high"), ok.alias("ok")))
    rows = df.select(entity, "us", F.array(*each).alias("_h")).select(entity, "us", F.explode("_h").alias("_h")).select("_h.*", entity, "us")
    return rows.where("ok").select("sustain_s", entity, "us", "high")


def records(held: DataFrame, entity: str = "entity") -> DataFrame:
    """(sustain_s, entity, us, high, before): held scores above all earlier
    ones, with the one before. Every threshold is first crossed at one."""
    w = Window.partitionBy("sustain_s", entity).orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    top = held.withColumn("before", F.max("high").over(w))
    return top.where(F.col("before").isNull() | (F.col("high") > F.col("before")))


def fire_steps(held: DataFrame, grid: list[float], entity: str = "entity") -> DataFrame:
    """(sustain_s, entity, threshold, fire_us) of the thresholds that are
    reached. A record fires those of the grid between it and the one before,
    so nothing is joined."""
    th = F.array(*map(F.lit, grid))
    new = F.filter(th, lambda t: (t <= F.col("high")) & (F.col("before").isNull() | (t > F.col("before"))))
    return records(held, entity).select("sustain_s", entity, F.explode(new).alias("threshold"), F.col("us").alias("fire_us"))


def fire_times(highs: DataFrame, thresholds: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, threshold, fire_us) of the thresholds that are reached.
    ``thresholds``: a small grid; records are few, so they meet all of it."""
    return highs.join(F.broadcast(thresholds), highs["high"] >= thresholds["threshold"]).groupBy(entity, "threshold").agg(F.min("us").alias("fire_us"))


def outcome(fire_us: Column, onset_us: Column, early_s: float, late_s: float) -> Column:
    """What a single firing is worth. Without an onset any firing is false."""
    before, after = onset_us - int(early_s * S), onset_us + int(late_s * S)
    none = F.when(fire_us.isNull(), "nofire").otherwise("false_fire")
    seen = F.when(fire_us.isNull(), "nofire").when(fire_us < before, "early").when(fire_us <= after, "hit").otherwise("late")
    return F.when(onset_us.isNull(), none).otherwise(seen)


def too_early(fire_us: Column, onset_us: Column, early_us: Column) -> Column:
    """A false fire: before the allowed time, or without an event."""
    return F.coalesce(fire_us.isNotNull() & (onset_us.isNull() | (fire_us < onset_us - early_us)), F.lit(False))


def is_hit(fire_us: Column, onset_us: Column, early_us: Column, late_us: Column) -> Column:
    return F.coalesce((fire_us >= onset_us - early_us) & (fire_us <= onset_us + late_us), F.lit(False))


def _n(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def frontier(fires: DataFrame, naps: DataFrame, grid: list[float], sustains_s: list[float], earlies_s: list[float], lates_s: list[float], entity: str = "entity") -> DataFrame:
    """(sustain_s, early_s, late_s, threshold, ff_rate, hit_rate): all limits
    are counted in one pass. ``naps``: (entity, onset_us); thresholds that
    nothing reaches have rates of 0."""
    spark = fires.sparkSession
    joined = fires.join(naps.select(entity, "onset_us"), entity)
    us = lambda s: F.lit(int(s * S))
    fire, onset = F.col("fire_us"), F.col("onset_us")
    counts = [_n(too_early(fire, onset, us(e))).alias(f"f{i}") for i, e in enumerate(earlies_s)]
    counts += [_n(is_hit(fire, onset, us(e), us(v))).alias(f"h{i}_{j}") for i, e in enumerate(earlies_s) for j, v in enumerate(lates_s)]
    per = joined.groupBy("sustain_s", "threshold").agg(*counts)
    cells = F.array(*[F.struct(F.lit(e).alias("early_s"), F.lit(v).alias("late_s"), F.col(f"f{i}").alias("ff"), F.col(f"h{i}_{j}").alias("hit")) for i, e in enumerate(earlies_s) for j, v in enumerate(lates_s)])
    found = per.select("sustain_s", "threshold", F.explode(cells).alias("c")).select("sustain_s", "c.*", "threshold")
    every = spark.createDataFrame([(s, e, v, t) for s in sustains_s for e in earlies_s for v in lates_s for t in grid], "sustain_s int, early_s int, late_s int, threshold double")
    total = naps.agg(F.count("*").alias("n"), F.greatest(F.count("onset_us"), F.lit(1)).alias("n_onset"))
    keys = ["sustain_s", "early_s", "late_s", "threshold"]
    filled = F.broadcast(every).join(found, keys, "left").crossJoin(F.broadcast(total))  # a grid and one row
    rate = lambda c, n: F.coalesce(c, F.lit(0)) / F.col(n)
    return filled.select(*keys, rate("ff", "n").alias("ff_rate"), rate("hit", "n_onset").alias("hit_rate"))


def guarded_threshold(false_values: DataFrame, budget: float, by: list[str], never: float = 1.01) -> DataFrame:
    """(by, threshold): the quantile 1 - budget of the highest scores outside
    the allowed time in training entities; ``never`` if there are none."""
    return false_values.groupBy(*by).agg(F.coalesce(F.percentile(F.col("false_high"), F.lit(1 - budget)), F.lit(never)).alias("threshold"))


def guarded_thresholds(highs: DataFrame, naps: DataFrame, earlies_s: list[float], budgets: list[float], folds: int, never: float = 1.01, entity: str = "entity") -> DataFrame:
    """(sustain_s, early_s, budget, fold, threshold): for each fold the quantile
    1 - budget of the other folds' highest scores before the allowed time.
    ``highs``: records; ``naps``: (entity, fold, onset_us)."""
    joined = highs.join(naps.select(entity, "fold", "onset_us"), entity)
    allowed = lambda e: F.col("onset_us").isNull() | (F.col("us") < F.col("onset_us") - int(e * S))
    tops = joined.groupBy("sustain_s", entity, "fold").agg(*[F.max(F.when(allowed(e), F.col("high"))).alias(f"t{i}") for i, e in enumerate(earlies_s)])
    each = tops.select("sustain_s", "fold", F.explode(F.array(*[F.struct(F.lit(e).alias("early_s"), F.col(f"t{i}").alias("top")) for i, e in enumerate(earlies_s)])).alias("e")).select("sustain_s", F.col("fold").alias("_own"), "e.*")
    train = each.withColumn("fold", F.explode(F.array(*map(F.lit, range(folds))))).where("fold != _own")
    by = ["sustain_s", "early_s", "fold"]
    known = train.groupBy(*by).agg(F.count("top").alias("_n"))
    quantiles = known.join(ranked_quantiles(train, "top", {f"q{i}": round(1 - b, 12) for i, b in enumerate(budgets)}, by), by, "left")
    cells = F.array(*[F.struct(F.lit(b).alias("budget"), F.coalesce(f"q{i}", F.lit(never)).alias("threshold")) for i, b in enumerate(budgets)])
    return quantiles.select("sustain_s", "early_s", "fold", F.explode(cells).alias("c")).select("sustain_s", "early_s", "c.budget", "fold", "c.threshold")


def event_surface(highs: DataFrame, naps: DataFrame, thresholds: DataFrame, lates_s: list[float], entity: str = "entity") -> DataFrame:
    """(sustain_s, early_s, late_s, budget, hit_mean, hit_min, hit_max, ff_mean)
    over folds: hits among entities with an event, false fires among all, at
    the thresholds (sustain_s, early_s, budget, fold, threshold), a grid by
    folds, that ``guarded_thresholds`` gives."""
    crossed = highs.join(naps.select(entity, "fold"), entity).join(F.broadcast(thresholds), ["sustain_s", "fold"]).where("high >= threshold")
    fires = crossed.groupBy("sustain_s", "early_s", "budget", entity).agg(F.min("us").alias("fire_us"))
    every = naps.select(entity, "fold", "onset_us").join(F.broadcast(thresholds.drop("threshold")), "fold").join(fires, ["sustain_s", "early_s", "budget", entity], "left")
    early, fire, onset = F.col("early_s").cast("long") * S, F.col("fire_us"), F.col("onset_us")
    hits = [_n(is_hit(fire, onset, early, F.lit(int(v * S)))).alias(f"h{j}") for j, v in enumerate(lates_s)]
    folds = every.groupBy("sustain_s", "early_s", "budget", "fold").agg(F.count("*").alias("n"), F.count("onset_us").alias("n_onset"), _n(too_early(fire, onset, early)).alias("ff"), *hits)
    cells = F.array(*[F.struct(F.lit(v).alias("late_s"), F.try_divide(F.col(f"h{j}").cast("double"), F.col("n_onset")).alias("hit")) for j, v in enumerate(lates_s)])
    rows = folds.select("sustain_s", "early_s", "budget", (F.col("ff") / F.col("n")).alias("ff"), F.explode(cells).alias("c")).select("sustain_s", "early_s", "c.late_s", "budget", "c.hit", "ff")
    return rows.groupBy("sustain_s", "early_s", "late_s", "budget").agg(F.avg("hit").alias("hit_mean"), F.min("hit").alias("hit_min"), F.max("hit").alias("hit_max"), F.avg("ff").alias("ff_mean"))


def floor_ceiling(held: DataFrame, naps: DataFrame, thresholds: DataFrame, floors_s: list[float], ceilings_s: list[float], rules: FiringRules, entity: str = "entity") -> DataFrame:
    """A row per floor, ceiling and budget: false fires and catches of the first
    crossing between floor and ceiling after falling asleep, as mean, least and
    most over folds; the same without them; where the false fires without them
    lie; and how many events come before the floor. ``held``: all held rows,
    not only records; ``naps``: (entity, fold, onset_us, sleep_us);
    ``thresholds``: (budget, fold, threshold)."""
    crossed = held.join(naps.select(entity, "fold", "sleep_us"), entity).join(F.broadcast(thresholds), "fold").where("high >= threshold")
    since = F.col("us") - F.col("sleep_us")
    pairs = [(i, j, f, c) for i, f in enumerate(floors_s) for j, c in enumerate(ceilings_s)]
    inside = [F.min(F.when((since >= int(f * S)) & (since <= int(c * S)), F.col("us"))).alias(f"g{i}_{j}") for i, j, f, c in pairs]
    fires = crossed.groupBy("budget", entity).agg(F.min("us").alias("fire_us"), *inside)
    every = naps.select(entity, "fold", "onset_us", "sleep_us").join(F.broadcast(thresholds.drop("threshold")), "fold").join(fires, ["budget", entity], "left")
    cells = F.array(*[F.struct(F.lit(f).alias("floor_s"), F.lit(c).alias("ceil_s"), F.col(f"g{i}_{j}").alias("gated_us")) for i, j, f, c in pairs])
    rows = every.select("budget", "fold", "onset_us", "sleep_us", "fire_us", F.explode(cells).alias("c")).select("*", "c.*")
    early, late, fire, onset, asleep = F.lit(int(rules.early_s * S)), F.lit(int(rules.late_s * S)), F.col("fire_us"), F.col("onset_us"), F.col("sleep_us")
    uff = too_early(fire, onset, early)
    floor_us, ceil_us = asleep + F.col("floor_s").cast("long") * S, asleep + F.col("ceil_s").cast("long") * S
    keys = ["floor_s", "ceil_s", "budget"]
    folds = rows.groupBy(*keys, "fold").agg(
        F.count("*").alias("n"), F.count("onset_us").alias("n_onset"), _n(too_early(F.col("gated_us"), onset, early)).alias("gff"), _n(is_hit(F.col("gated_us"), onset, early, late)).alias("ghit"),
        _n(uff).alias("uff"), _n(is_hit(fire, onset, early, late)).alias("uhit"), _n(uff & (fire < floor_us)).alias("low"), _n(uff & (fire > ceil_us)).alias("high"), _n(onset < floor_us).alias("lost"),
    )
    share = lambda c: F.col(c) / F.col("n")
    spread = lambda c, name: [f(share(c)).alias(f"{name}_{k}") for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    sums = [F.sum(c).alias(c) for c in ("low", "high", "lost", "n_onset")]
    out = folds.groupBy(*keys).agg(*spread("gff", "gated_ff"), *spread("ghit", "gated_catch"), F.avg(share("uff")).alias("ungated_ff_mean"), F.avg(share("uhit")).alias("ungated_catch_mean"), F.sum("uff").alias("orig_ff_n"), *sums, F.sum("n").alias("n_scorable"))
    return out.select(
        *keys, *[f"{a}_{b}" for a in ("gated_ff", "gated_catch") for b in ("mean", "min", "max")], "ungated_ff_mean", "ungated_catch_mean", "orig_ff_n", F.col("low").alias("ff_removed_floor"),
        (F.col("orig_ff_n") - F.col("low") - F.col("high")).alias("ff_remain_window"), F.col("high").alias("ff_removed_ceil"), F.col("lost").alias("early_deep_fail_n"), F.try_divide(F.col("lost").cast("double"), F.col("n_onset")).alias("early_deep_fail_frac"), "n_scorable",
    )


def depth_costs(nights: DataFrame, margins: list[float], tolerances: list[float], past: str = "past", hard: str = "hard") -> DataFrame:
    """A row for each margin ``m`` and tolerated depth ``d``: failures, nights
    that fire deeper than ``d`` past the onset, where depth is ``past - m``; how
    deep they are; the hard class's share of them and of all nights; what
    firing sacrifices before the onset; and how many nights land before it or
    within the tolerance. All cells are conditional sums of one pass; quartiles
    above a bound are ranks in one table. ``nights`` is read twice."""
    x, is_hard = F.col(past), F.col(hard)
    cells = [(m, d) for m in margins for d in tolerances]
    per_margin = [e for i, m in enumerate(margins) for e in (_n(x - m <= 0).alias(f"before{i}"), F.sum(F.when(x - m <= 0, m - x)).alias(f"given{i}"))]
    per_cell = [e for k, (m, d) in enumerate(cells) for e in (_n(x - m > d).alias(f"fails{k}"), _n((x - m > d) & is_hard).alias(f"hard{k}"))]
    known = nights.agg(F.count(x).alias("n"), _n(is_hard).alias("all_hard"), F.max(x).alias("top"), *per_margin, *per_cell).first()  # a number a cell
    counts = nights.where(x.isNotNull()).groupBy(x.cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = ranked_values(counts)
    places = {}
    for k in range(len(cells)):
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            if known[f"fails{k}"]:
                at = known["n"] - known[f"fails{k}"] + (known[f"fails{k}"] - 1) * p
                places[f"{name}{k}"] = (int(at), -int(-at // 1), at - int(at))
    ends = sorted({r for low, high, _ in places.values() for r in (low, high)})
    holds = F.exists(F.array(*[F.lit(r).cast("long") for r in ends]), lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")))
    held = ranked.where(holds).collect() if ends else []  # at most a row for each rank
    value = {r: row["_v"] for row in held for r in ends if row["_before"] <= r < row["_before"] + row["_n"]}
    rows = []
    for k, (m, d) in enumerate(cells):
        i, n, fails = margins.index(m), known["n"], known[f"fails{k}"]
        quartiles = [None if (at := places.get(f"{name}{k}")) is None else value[at[0]] + (value[at[1]] - value[at[0]]) * at[2] - m for name in ("q1", "median", "q3")]
        before, given = known[f"before{i}"], known[f"given{i}"]
        if n:
            rows.append((m, d, n, fails, 100.0 * fails / n, *quartiles, known["top"] - m if fails else None, given / before if before else None, (given or 0.0) / n, 100.0 * known[f"hard{k}"] / fails if fails else None, 100.0 * known["all_hard"] / n, before, n - before - fails))
    kinds = ", ".join(f"{c} double" for c in ("fail_pct", "depth_q1", "depth_median", "depth_q3", "depth_max", "sacrifice_nonfail", "sacrifice_all", "hard_share_pct", "hard_nights_pct"))
    number = "int" if all(isinstance(v, int) for v in [*margins, *tolerances]) else "double"
    return nights.sparkSession.createDataFrame(rows, f"m {number}, d {number}, nights long, fails long, {kinds}, before long, in_band long")


def gated(highs: DataFrame, starts: DataFrame, floor_s: float, ceil_s: float, threshold: Column, entity: str = "entity") -> DataFrame:
    """(entity, fire_us, gated_us): the first crossing, and the first one in
    [start + floor, start + ceil]. ``highs`` are all sustained rows, not only
    records; ``starts``: (entity, start_us)."""
    joined = highs.join(starts, entity).where(F.col("high") >= threshold)
    since = F.col("us") - F.col("start_us")
    inside = (since >= int(floor_s * S)) & (since <= int(ceil_s * S))
    return joined.groupBy(entity).agg(F.min("us").alias("fire_us"), F.min(F.when(inside, F.col("us"))).alias("gated_us"))
