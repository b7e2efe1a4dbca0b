"""Scans and windows in chunks against those over whole series."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftline.operators import beats, chunks, intervals, joins, series
from driftline.params import BeatRules, FeatureWindows

MANY = 1 << 40


@pytest.fixture(scope="module")
def samples(spark):
    """A third of all rows in one entity, a null entity, and many small ones."""
    rng = random.Random(11)
    rows = []
    for entity, n in [(1, 400), (None, 150), (2, 1), *[(k, 12) for k in range(3, 50)]]:
        for us in rng.sample(range(0, 40 * n), n):
            rows.append((entity, us * 1_000_000, rng.choice([None, rng.randint(0, 30), rng.random() * 30]), rng.choice("abc")))
    return spark.createDataFrame([(e, u, None if v is None else float(v), c) for e, u, v, c in rows], "entity long, us long, value double, kind string").cache()


@pytest.fixture(scope="module")
def spans(samples):
    ends = F.col("us") + F.pmod(F.xxhash64("us", "kind"), F.lit(200)) * 1_000_000
    some = samples.select("entity", F.col("us").alias("start_us"), ends.alias("end_us"), F.col("kind").alias("label"), F.lit("s").alias("source"))
    return some.unionByName(some.where("label = 'a'")).cache()  # and rows that repeat


def same(left, right):
    def rounded(df):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)

    assert rounded(left) == rounded(right)


@pytest.mark.parametrize("rows", [9])
def test_scans_of_intervals(spans, rows):
    by = ["entity"]
    for gap in (0.0, 20.0):
        same(intervals.merged(spans, by, gap, rows=rows), intervals.merged(spans, by, gap, rows=MANY))
    same(intervals.merged_in_order(spans, "label", 30, rows=rows), intervals.merged_in_order(spans, "label", 30, rows=MANY))
    same(intervals.union_minutes(spans, ["entity", "label"], rows=rows), intervals.union_minutes(spans, ["entity", "label"], rows=MANY))
    args = (["a", "b", "c"], ["a", "b"], 60)
    same(intervals.session_summary(spans, *args, rows=rows), intervals.session_summary(spans, *args, rows=MANY))


@pytest.mark.parametrize("rows", [9])
def test_scans_of_samples(samples, rows):
    is_a = F.col("kind") == "a"
    same(series.record_highs(samples, rows=rows), series.record_highs(samples, rows=MANY))
    same(joins.next_event(samples, is_a, rows=rows), joins.next_event(samples, is_a, rows=MANY))
    rest, events = samples.where(~is_a), samples.where(is_a)
    same(joins.nearest_event(rest, events, rows=rows), joins.nearest_event(rest, events, rows=MANY))


@pytest.mark.parametrize("rows", [7, 60])
def test_windows_of_samples(samples, rows):
    rules = FeatureWindows()
    same(series.features(samples, rules, rows=rows), series.features(samples, rules, rows=MANY))
    around = lambda by: {"med": F.percentile("value", F.lit(0.5)).over(series.centred(300, by)), "n": F.count("*").over(series.trailing(90, by, closed=False))}
    same(chunks.widened(samples, around, 150_000_000, 150_000_000, rows=rows), chunks.widened(samples, around, 150_000_000, 150_000_000, rows=MANY))


def test_variability_in_chunks(samples):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("entity").orderBy("us"))
    b = samples.select("entity", "us", (F.coalesce("value", F.lit(40.0)) * 30).alias("rr"), number.alias("i"), F.col("value").isNotNull().alias("keep"))
    rules = BeatRules(min_coverage=0.0, window_s=600)
    found = beats.variability(b, rules, rows=20)
    same(found, beats.variability(b, rules, rows=MANY))
    assert found.where("ln_rmssd IS NOT NULL").count() > 100


def test_no_task_holds_a_long_series(spark):
    """A third of all rows in one entity: no window task has more than chunk and halo."""
    df = spark.range(0, 12_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(1000 + F.col("id")).alias("entity"), (F.col("id") * 1_000_000).alias("us"), (F.col("id") % 97).cast("double").alias("value"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}

    def largest(found):
        return max(Counter(r[0] for r in found.select(F.spark_partition_id(), "*").collect()).values())

    try:
        for k, v in zip(kept, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        window = lambda by: {"sd": F.stddev_samp("value").over(series.trailing(60, by))}
        assert largest(chunks.widened(df, window, 60_000_000, rows=MANY)) > 4_000
        assert largest(chunks.widened(df, window, 60_000_000, rows=200)) < 1_000
        assert largest(joins.next_event(df, F.col("value") == 5, rows=200)) < 1_000
        assert largest(series.record_highs(df.withColumn("value", F.col("us").cast("double")), rows=200)) < 1_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_cuts_are_about_equal(samples):
    assert chunks.long_groups(samples, ["entity"], "us", 400) is None
    cuts = {r["_g"]: r["_cuts"] for r in chunks.long_groups(samples, ["entity"], "us", 60).collect()}
    assert {k: len(v) for k, v in cuts.items()} == {"=1": 6, "": 2}
    at = sorted(r["us"] for r in samples.where("entity = 1").collect())
    sizes = Counter(sum(c <= u for c in cuts["=1"]) for u in at)
    assert len(sizes) == 7 and max(sizes.values()) < 120
