"""Work on huge groups without one task per group: joins on keys of which one
may hold a third of all rows, and places and running sums in groups of any
size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialized

#: A key with more than one in so many rows is split.
PARTS = 200


def spread_join(facts: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "inner", n: str = "n", total: int | None = None, parts: int = PARTS) -> DataFrame:
    """``facts`` joined with ``table``, which has one row a key and says in
    ``n`` how many facts have that key; ``n`` itself doesn't come back.

    Keys with more than ``1 / parts`` of the facts are split: their facts are
    dealt over several copies of the key's row. There are fewer than ``parts``
    such keys, whatever the size of the data, so that their list may be
    broadcast. Keys that are null don't meet. ``by`` names columns that tell
    facts of one key apart: their hash deals them, so that a task that runs
    again after a lost executor deals them the same way.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] if total is None else total
    share = max(1, -(-total // parts))
    copies = F.ceil(F.col(n) / share).cast("long")
    heavy = table.where(F.col(n) > share).select(*keys, copies.alias("_copies"))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_copies")), F.lit(0).cast("long"))
    dealt = facts.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_copies")
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(copies, F.lit(1).cast("long")) - 1))).drop(n)
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


#: Rows of a part of a range, and how many parts there are at least and at most.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1_000_000, 64, 4096


def splitters(df: DataFrame, value: str, parts: int | None = None) -> list:
    """Values that cut a column into about equal parts, of ``PART_ROWS`` rows
    where that makes neither too few nor too many; fewer where it has few."""
    if parts is None:
        parts = min(MOST_PARTS, max(LEAST_PARTS, -(-df.count() // PART_ROWS)))
    found = df.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return sorted(set(found or []))


def part_of(value: Column, cuts: list, block: int = 64) -> Column:
    """How many of the cuts are at most ``value``; rises with it. Of many cuts,
    first those that begin a block are counted, then those of one block."""
    below = lambda array: F.size(F.filter(array, lambda c: c <= value))
    if not cuts:
        return F.lit(0)
    if len(cuts) <= block:
        return below(F.array(*map(F.lit, cuts)))
    blocks = [cuts[i : i + block] for i in range(0, len(cuts), block)]
    at = below(F.array(*[F.lit(b[0]) for b in blocks]))
    inside = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), at - 1)
    return F.when(at > 0, (at - 1) * block + below(inside)).otherwise(0)


def running(df: DataFrame, group: str, bucket: Column, order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """``running_sums`` of one amount."""
    return running_sums(df, group, bucket, order, {name: amount})


def running_sums(df: DataFrame, group: str, bucket: Column, order: list[str | Column], amounts: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each amount: its sum over the rows of the same
    ``group`` that come before. ``bucket`` must rise with ``order``: bucket
    totals, a small table, are summed up first, and the window over rows then
    runs within buckets. Rows that tie come in any order. ``df`` is read twice,
    so it should be a written table."""
    # never null, so that a plain join keeps the window's partitioning
    no_null = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    mine = {name: f"_amount{k}" for k, name in enumerate(amounts)}
    placed = df.withColumn("_g", no_null).withColumn("_bucket", bucket).withColumns({mine[name]: amount.cast("long") for name, amount in amounts.items()})
    totals = placed.groupBy("_g", "_bucket").agg(*[F.sum(c).alias(c) for c in mine.values()])
    before = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_g", "_bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in mine.values()])
    inside = Window.partitionBy("_g", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in mine.values()})
    summed = ranked.join(starts, ["_g", "_bucket"]).withColumns({name: F.col(f"{c}_start") + F.col(f"{c}_inside") for name, c in mine.items()})
    return summed.drop("_g", "_bucket", *[x for c in mine.values() for x in (c, f"{c}_start", f"{c}_inside")])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, rows_per_part: int = 200_000) -> DataFrame:
    """``df`` with ``name``: the place, from 0, of each row among those of its
    group, by ``order``, nulls first. Rows are sorted once by range, so a group
    of any size is spread over tasks; how many rows of a group come in the
    parts before, a table with a row for each group and part, is summed up
    afterwards. Rows that tie in all of ``order`` come in any order but each
    get a place of their own. ``by`` must not be null. ``df`` is read three
    times, so it should be a written table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-df.count() // rows_per_part))
    in_order = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # the upper bits of the id are the part, which rises with the order
    placed = materialized(in_order.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    firsts = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select(*by, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, [*by, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
