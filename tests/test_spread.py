"""Joins and running sums whose keys are very uneven."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from driftline.operators import spread


def test_spread_join_gives_what_a_join_gives_and_splits_heavy_keys(spark):
    facts = spark.range(0, 9_000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(1000 + F.col("id")).cast("long").alias("k"))
    table = facts.where("k IS NOT NULL AND k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    for how in ("inner", "left", "left_semi"):
        got = spread.spread_join(facts, table, ["k"], ["v"], how, parts=20)
        want = facts.join(table.drop("n"), ["k"], how)
        assert sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=repr) == sorted(map(tuple, want.select(sorted(want.columns)).collect()), key=repr)
    empty = spread.spread_join(facts.limit(0), table.limit(0), ["k"], ["v"])
    assert empty.count() == 0


def test_no_task_of_a_spread_join_holds_the_heavy_key(spark):
    facts = spark.range(0, 12_000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, 7).otherwise(1000 + F.col("id")).alias("k"))
    table = facts.groupBy("k").agg(F.count("*").alias("n"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("40", "-1", "false"), strict=True):
            spark.conf.set(k, v)
        sizes = Counter(r[0] for r in spread.spread_join(facts, table, ["k"], ["v"], parts=60).select(F.spark_partition_id()).collect())
        plain = Counter(r[0] for r in facts.join(table, "k").select(F.spark_partition_id()).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(plain.values()) > 4_000 and max(sizes.values()) < 1_200


def test_running_sums_over_buckets(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 500).alias("v"))
    rows = spread.running(df, "g", F.floor(F.col("v") / 40), ["v"], F.col("v"), "before").collect()
    for g in range(3):
        total = 0
        for v, before in sorted((r["v"], r["before"]) for r in rows if r["g"] == g):
            assert before == total
            total += v


def test_parts_of_a_range(spark):
    """Few and many cuts, with values on, between and beyond them."""
    df = spark.range(0, 2_000).select((F.col("id") / 4).alias("v"))
    for n in (0, 1, 64, 65, 700):
        cuts = [float(k) * 0.7 for k in range(n)]
        got = df.select("v", spread.part_of(F.col("v") - 3, cuts).alias("k")).collect()
        assert all(r["k"] == sum(c <= r["v"] - 3 for c in cuts) for r in got)
    assert len(spread.splitters(df, "v", 400)) == 399 and spread.splitters(df.limit(0), "v") == []


def test_numbers_in_groups_of_any_size(spark):
    rows = [(g, k % 50, k) for g, n in (("", 700), ("a", 3), ("b", 300)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(5)
    got = spread.numbered(df, ["g"], ["o", "id"], "at", rows_per_part=40).collect()
    for g in ("", "a", "b"):
        mine = sorted(((r["o"], r["id"]), r["at"]) for r in got if r["g"] == g)
        assert [at for _, at in mine] == list(range(len(mine)))
    assert len(got) == len(rows)
