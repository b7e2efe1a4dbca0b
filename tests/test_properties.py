"""Operators on random series against plain loops."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.operators import intervals, joins, series, stats
from driftline.streaming import phase

S = 1_000_000


def series_rows(seed, entities=6, n=60):
    rng = random.Random(seed)
    return [(e, us, rng.choice([0.5, 1, 2, 3, 5, 8]), rng.random() < 0.2) for e in range(entities) for us in sorted(rng.sample(range(0, 5000), n))]


def frame(spark, rows):
    return spark.createDataFrame([(e, us * S, float(v), x) for e, us, v, x in rows], "entity int, us long, value double, x boolean")


def test_next_and_nearest_events(spark):
    rows = series_rows(1)
    df = frame(spark, rows)
    events = {e: [us for f, us, _, x in rows if f == e and x] for e in range(6)}
    for r in joins.next_event(df, F.col("x")).collect():
        after = [u * S for u in events[r["entity"]] if u * S > r["us"]]
        assert r["tau"] == ((min(after) - r["us"]) / S if after else None)
    for r in joins.nearest_event(df.where("NOT x"), df.where("x")).collect():
        assert r["near_us"] == min((u * S for u in events[r["entity"]]), key=lambda u: (abs(u - r["us"]), u))


def test_unions_cover_no_more_than_their_parts(spark):
    rng = random.Random(2)
    rows = [(e, a, a + rng.randrange(1, 300)) for e in range(8) for a in (rng.randrange(0, 3000) for _ in range(25))]
    df = spark.createDataFrame([(e, a * 60 * S, b * 60 * S) for e, a, b in rows], "entity int, start_us long, end_us long")
    for r in intervals.union_minutes(df, ["entity"]).collect():
        own = [(a, b) for e, a, b in rows if e == r["entity"]]
        assert r["minutes"] == len({m for a, b in own for m in range(a, b)}) <= sum(b - a for a, b in own)


def test_overlaps_by_buckets_are_all_overlaps(spark):
    rng = random.Random(3)
    make = lambda n, k: [(rng.randrange(3), i, a, a + rng.randrange(0, k)) for i in range(n) for a in [rng.randrange(0, 10_000)]]
    left, right = make(40, 3000), make(40, 800)
    df = lambda rows: spark.createDataFrame([(e, i, a * S, b * S) for e, i, a, b in rows], "entity int, id int, start_us long, end_us long")
    got = sorted((r["l_id"], r["r_id"], r["overlap_us"] // S) for r in intervals.overlaps(df(left), df(right), width_s=500).collect())
    assert got == sorted((i, j, min(b, d) - max(a, c)) for e, i, a, b in left for f, j, c, d in right if e == f and max(a, c) < min(b, d))
    points = spark.createDataFrame([(e, t * S) for e in range(3) for t in range(0, 13_000, 97)], "entity int, us long")
    inside = {(r["entity"], r["us"] // S) for r in intervals.in_intervals(points, df(right), width_s=500, how="semi").collect()}
    assert inside == {(e, t) for e in range(3) for t in range(0, 13_000, 97) if any(f == e and a <= t <= b for f, _, a, b in right)}


def test_records_increase_and_windows_match_loops(spark):
    rows = series_rows(4)
    df = frame(spark, rows)
    for e in range(6):
        tops = [r["value"] for r in series.record_highs(df).where(F.col("entity") == e).orderBy("us").collect()]
        assert tops == sorted(set(tops))
    held, _ = series.sustained_min(F.col("value"), F.col("us"), 100, 20)
    for r in df.withColumn("m", held).collect():
        assert r["m"] == min(v for e, us, v, _ in rows if e == r["entity"] and r["us"] // S - 100 <= us <= r["us"] // S)
    assert sum(r["n"] for r in series.runs(df, F.col("x")).collect()) == sum(x for *_, x in rows)
    assert {r["n"] for r in stats.cadence(df).collect()} == {60}


def test_dedup_within_a_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "id string, t long").withColumn("at", F.timestamp_seconds("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = phase.one_each(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "id", "at")
    live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=30))
def test_spread_of_the_phase_machine(xs):
    import statistics

    want = statistics.stdev(xs) if len(xs) > 1 else 0.0
    assert abs(phase.spread(xs) - want) < 1e-6 * (1 + want)
