"""Leak-safe evaluation: group folds, exact ranking metrics, verdicts."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialized
from . import spread
from .series import S
from .stats import ranked_quantiles


def lead_labels(df: DataFrame, leads_s: list[float], tau: str = "tau") -> DataFrame:
    """A row for each lead: y is whether the next event comes within it; a row
    without a next event is never positive."""
    return df.withColumn("lead_s", F.explode(F.array(*[F.lit(float(x)) for x in leads_s]))).withColumn("y", F.coalesce(F.col(tau) <= F.col("lead_s"), F.lit(False)).cast("int"))


def hash_folds(group: Column, folds: int) -> Column:
    """The fold of a group by a hash of its name: no table, no driver."""
    return F.pmod(F.crc32(group.cast("string")), F.lit(folds)).cast("int")


def group_folds(df: DataFrame, group: str, folds: int, parts: int = 250) -> DataFrame:
    """(group, fold): whole groups, the largest first, each to the lightest
    fold. Groups of at most a ``folds * parts``-th of all rows are gathered by
    a hash into as many bundles, which are placed like groups, so that at most
    twice ``folds * parts`` items reach the driver, however many groups."""
    bundles = folds * parts
    a, b = F.xxhash64(group), F.xxhash64(F.lit("second"), group)
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    large = F.col("_n") * bundles > total
    keyed = sizes.select(group, "_n", large.alias("_own"), F.when(large, a).otherwise(F.pmod(a, F.lit(bundles))).alias("_a"), F.when(large, b).otherwise(F.lit(0)).alias("_b"))
    items = keyed.groupBy("_own", "_a", "_b").agg(F.sum("_n").alias("_n")).collect()
    heap = [(0, k) for k in range(folds)]
    placed = []
    for row in sorted(items, key=lambda r: (-r["_n"], r["_own"], r["_a"], r["_b"])):
        load, fold = heapq.heappop(heap)
        placed.append((row["_own"], row["_a"], row["_b"], fold))
        heapq.heappush(heap, (load + row["_n"], fold))
    table = df.sparkSession.createDataFrame(placed, "_own boolean, _a long, _b long, fold int")
    return keyed.join(F.broadcast(table), ["_own", "_a", "_b"]).select(group, "fold")


def _by_score(df: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, _by, _s, p, n) for each distinct score, written."""
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(y)).cast("long").alias("p"), F.count("*").alias("n"))
    return materialized(counts.withColumn("_by", F.struct(*by).cast("string")), "scores")


def auroc(df: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, positives, auroc), exact, ties at half; null without both
    classes. Rows are counted by distinct score first; how many are below comes
    from sums over parts of the scores' range, so no task sorts all of them."""
    counts = _by_score(df, score, y, by)
    part = spread.part_of(F.col("_s"), spread.splitters(counts, "_s"))
    ranked = spread.running(counts.withColumn("neg", F.col("n") - F.col("p")), "_by", part, ["_s"], F.col("neg"), "under")
    wins = F.sum(F.col("p").cast("double") * (F.col("under") + F.col("neg") / 2))
    pairs = F.sum("p").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum("p").cast("long").alias("positives"), F.when(pairs > 0, wins / pairs).alias("auroc"))


def auprc(df: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, auprc): step-wise average precision, tied scores in one step; null
    without a positive. Sums over parts of the scores' range, as in ``auroc``."""
    counts = _by_score(df, score, y, by)
    part = -spread.part_of(F.col("_s"), spread.splitters(counts, "_s"))
    above = spread.running_sums(counts, "_by", part, [F.desc("_s")], {"tp": F.col("p"), "seen": F.col("n")})
    steps = above.withColumn("tp", F.col("tp") + F.col("p")).withColumn("seen", F.col("seen") + F.col("n"))
    area = F.sum(F.col("p").cast("double") * F.col("tp") / F.col("seen"))
    return steps.groupBy(*by).agg(F.when(F.sum("p") > 0, area / F.sum("p").cast("double")).alias("auprc"))


def fold_spread(df: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """mean, least, median and most of a metric over folds; nulls don't count."""
    x = F.col(metric)
    return df.groupBy(*by).agg(F.count(x).alias("folds"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).alias("most"))


def read_average(df: DataFrame, metric: str, by: list[str], fold: str = "fold") -> DataFrame:
    """Per fold the mean over the read points, then mean and least over folds."""
    per_fold = df.groupBy(*by, fold).agg(F.avg(metric).alias("_m"))
    return per_fold.groupBy(*by).agg(F.avg("_m").alias("mean"), F.min("_m").alias("least"))


def passes(df: DataFrame, mean: float = 0.65, least: float = 0.60) -> DataFrame:
    return df.withColumn("passes", (F.col("mean") >= mean) & (F.col("least") >= least))


def comparable(df: DataFrame, low: float = 0.53, high: float = 0.69) -> DataFrame:
    return df.withColumn("comparable", F.col("mean").between(low, high))


def _bar(lift: Column, gains: Column, folds: Column, passing: float, failing: float) -> Column:
    won, lost = (lift >= passing) & (gains == folds), (lift < failing) | (folds - gains >= 2)
    return F.when(won, "PASS").when(lost, "FAIL").otherwise("INCONCLUSIVE")


def lift_verdict(paired: DataFrame, base: str, treated: str, by: list[str], passing: float = 0.04, failing: float = 0.02) -> DataFrame:
    """Mean paired lift over folds and a verdict: PASS if it is at least
    ``passing`` and all folds gain, FAIL if it is below ``failing`` or two folds
    or more don't gain, else INCONCLUSIVE."""
    d = F.col(treated) - F.col(base)
    out = paired.groupBy(*by).agg(F.count(d).alias("folds"), F.avg(d).alias("lift"), F.coalesce(F.sum((d > 0).cast("int")), F.lit(0)).cast("long").alias("gains"))
    return out.withColumn("verdict", _bar(F.col("lift"), F.col("gains"), F.col("folds"), passing, failing))


def treatment_verdict(per_fold: DataFrame, passing: float = 0.04, failing: float = 0.02, grows: float = 0.03) -> DataFrame:
    """One row from (arm, fold, lr_base, lr_treated, rf_base, rf_treated), with
    the arms ``all`` and ``subset``: the linear model's lift decides; a passing
    forest makes it inconclusive; a passing subset adds a note that can't make
    or unmake a pass; and whether the gap between the models grows."""
    lr, rf = F.col("lr_treated") - F.col("lr_base"), F.col("rf_treated") - F.col("rf_base")
    growth = rf - lr
    up = lambda x: F.count(F.when(x > 0, 1))
    arms = per_fold.groupBy("arm").agg(F.count("*").alias("folds"), F.avg(lr).alias("lr_lift"), up(lr).alias("lr_gains"), F.avg(rf).alias("rf_lift"), up(rf).alias("rf_gains"), F.avg(growth).alias("growth"), up(growth).alias("growing"))
    barred = arms.withColumns({f"{m}_verdict": _bar(F.col(f"{m}_lift"), F.col(f"{m}_gains"), F.col("folds"), passing, failing) for m in ("lr", "rf")})
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    row = barred.agg(*[of("all", c).alias(c) for c in ("lr_lift", "lr_gains", "lr_verdict", "rf_lift", "rf_gains", "rf_verdict", "growth", "growing")], of("subset", "lr_lift").alias("subset_lift"), of("subset", "lr_verdict").alias("subset_verdict"))
    main = F.when(F.col("lr_verdict") == "PASS", "PASS").when(F.col("rf_verdict") == "PASS", "INCONCLUSIVE (nonlinear signal)").otherwise(F.col("lr_verdict"))
    note = F.when((F.col("lr_verdict") != "PASS") & (F.col("subset_verdict") == "PASS"), " + INCONCLUSIVE (subset)").otherwise("")
    return row.withColumn("verdict", F.concat(main, note)).withColumn("gap_grows", (F.col("growth") >= grows) & (F.col("growing") >= 4))


def fold_bounds(df: DataFrame, columns: list[str], folds: int, low: float = 0.005, high: float = 0.995, fold: str = "fold") -> DataFrame:
    """(fold, c_low, c_high): quantiles of the rows of all other folds; a row
    per fold."""
    train = df.withColumn("_f", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col("_f") != F.col(fold)).drop(fold).withColumnRenamed("_f", fold)
    out = None
    for c in columns:
        found = ranked_quantiles(train, c, {f"{c}_low": low, f"{c}_high": high}, [fold])
        out = found if out is None else out.join(found, fold)
    return out


def winsorized(df: DataFrame, bounds: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """Values bounded by the training quantiles of the row's fold."""
    joined = df.join(F.broadcast(bounds), fold)
    new = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}_low")), F.col(f"{c}_high"))) for c in columns}
    return joined.withColumns(new).select(df.columns)


def forward_selection(candidates: list[str], fixed: list[str], evaluate, min_gain: float = 0.003, max_loss: float = 0.005) -> list[str]:
    """Greedy: in each round the candidate with the greatest mean joins if it
    gains enough and no fold loses too much. ``evaluate(sets)`` gives (mean,
    least over folds) of each of some sets of features, so that all sets of a
    round are fitted at once."""
    kept, left = list(fixed), list(candidates)
    now = evaluate([kept])[0]
    while left:
        scored = list(zip(evaluate([[*kept, c] for c in left]), left, strict=True))
        (mean, least), best = max(scored, key=lambda x: (x[0][0], x[1]))
        if mean - now[0] < min_gain or least - now[1] < -max_loss:
            break
        kept, now = [*kept, best], (mean, least)
        left.remove(best)
    return kept


def first_event_only(df: DataFrame, tau_first: str) -> DataFrame:
    """Rows before the entity's first event; all rows of one without events."""
    return df.where(F.col(tau_first).isNull() | (F.col(tau_first) > 0))


def scorable(entities: DataFrame, min_before_s: float) -> DataFrame:
    """Entities without an event, or with enough series before their first."""
    return entities.where(F.col("event_us").isNull() | (F.col("event_us") - F.col("start_us") >= int(min_before_s * S)))
