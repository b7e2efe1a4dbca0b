"""Sharding by longest-processing-time scheduling.

Documents with equal texts stay together. Groups, sorted by size, go to the
least-loaded shard through a heap. Groups of one size are alike to the heap,
so it takes the distinct sizes with their counts. There may be many: all bytes
of a group's copies count, and D distinct sizes need D * D / 2 bytes, so 100 TB
have 14 million at most. They pass through the driver in batches, in order;
what stays there is the heap. Many groups of one size are placed at once. Which
group of a size goes where is settled by its rank within its size, in a window
over buckets; documents meet their group in a join that splits heavy groups.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import numbered, spread_join
from . import store
from .ranks import SPAN, running
from .text import text_key


@dataclass(frozen=True)
class ShardRules:
    shards: int = 40
    #: Added to the bytes of each text.
    row_bytes: int = 16
    #: Sizes that are on the driver at once, about 2 kB each at most.
    batch: int = 50_000


class Loads:
    """The heap of (load, shard), which outlives the batches of sizes."""

    def __init__(self, shards: int):
        self.shards = shards
        self.heap = [(0, shard) for shard in range(shards)]

    def one_by_one(self, size: int, count: int) -> list[int]:
        """The shards of ``count`` items of one size, in their order: each goes to
        the least-loaded shard, ties to the smaller number."""
        out = []
        for _ in range(count):
            load, shard = self.heap[0]
            out.append(shard)
            heapq.heapreplace(self.heap, (load + size, shard))
        return out

    def at_once(self, size: int, count: int) -> list[int]:
        """How many of the items each shard gets, as if one by one."""
        loads = np.zeros(self.shards, np.int64)
        for load, shard in self.heap:
            loads[shard] = load
        given = filled(loads, size, count).tolist()
        self.heap = [(int(load) + size * n, shard) for shard, (load, n) in enumerate(zip(loads, given, strict=True))]
        heapq.heapify(self.heap)
        return given


PLAN = pa.schema([("bytes", pa.int64()), ("count", pa.int64()), ("each", pa.list_(pa.int16())), ("upto", pa.list_(pa.int64()))])


def planned(loads: Loads, sizes: list[int], counts: list[int]) -> pa.Table:
    """For each size, the largest first, which shard its items get by their
    rank: one by one (``each``) where there are fewer than shards, else how
    many items the shards up to each one get (``upto``)."""
    each, upto = [], []
    for size, count in zip(sizes, counts, strict=True):
        few = count < loads.shards
        each.append(loads.one_by_one(size, count) if few else None)
        upto.append(None if few else np.cumsum(loads.at_once(size, count)).tolist())
    return pa.table([pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(each, PLAN.field("each").type), pa.array(upto, PLAN.field("upto").type)], schema=PLAN)


def filled(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """What ``count`` items of one size, each to the least-loaded shard, add to
    each: the items before which a shard is at ``loads + k * size`` are taken
    in the order of that level, so all below some level are, and of those at
    it the first by number."""
    below = lambda level: np.maximum(0, -(-(level - loads) // size))
    low, high = int(loads.min()), int(loads.max()) + size * (count + 1)
    while high - low > 1:  # the greatest level below which at most count items lie
        mid = (low + high) // 2
        low, high = (mid, high) if below(mid).sum() <= count else (low, mid)
    given = below(low)
    at_level = np.flatnonzero((loads + given * size) == low)
    given[at_level[: count - int(given.sum())]] += 1
    return given


def plan_of(groups: DataFrame, rules: ShardRules) -> DataFrame:
    """(bytes, count, each, upto) of all sizes. The sizes come to the driver in
    their order, ``batch`` at a time, and leave it as a file of the shared
    folder before the next ones come; the heap is all that it keeps."""
    spark = groups.sparkSession
    runs = groups.groupBy("bytes").agg(F.count("*").alias("count"))
    sizes = store.written(runs.select(F.lit("").alias("g"), (-F.col("bytes")).alias("order"), "bytes", "count"), "runs")
    ordered = store.written(numbered(sizes, ["g"], ["order"], "pos"), "ordered")
    path = store.new_path(spark, "plan")
    loads = Loads(rules.shards)
    for at in range(0, max(1, ordered.count()), rules.batch):
        part = ordered.where(F.col("pos").between(at, at + rules.batch - 1)).select("pos", "bytes", "count").toArrow().sort_by("pos")
        table = planned(loads, part.column("bytes").to_pylist(), part.column("count").to_pylist())
        spark.createDataFrame(table).write.mode("append").parquet(path)
    return spark.read.schema("bytes long, count long, each array<short>, upto array<long>").parquet(path)


def assign(docs: DataFrame, rules: ShardRules = ShardRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): a row per input row. ``slot``
    counts from 0 without gaps within a shard.

    Null texts have ``row_bytes`` and form one group; their checksum is null.
    Very long texts are hashed where they are read and don't move.
    Empty texts are a group of their own, with checksum 0. Repeated rows are
    placed each, in one shard. Null ids are allowed. Rows that tie in
    everything may swap slots among themselves; groups of one size may swap
    shards if the text's hash is another one. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + rules.row_bytes
    key = text_key(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), key.a.alias("a"), key.b.alias("b"))
    rows = store.written(rows, "sizes")
    grouped = rows.groupBy("a", "b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = store.written(grouped.withColumn("key", F.pmod(F.xxhash64("b", "a"), F.lit(SPAN))), "groups")
    ranked = running(groups, "bytes", "key", ["a", "b"], F.lit(1), "rank")
    placed = spread_join(ranked, plan_of(groups, rules), ["bytes"], ["a", "b"], n="count", total=groups.count())
    shard = F.coalesce(F.get("each", F.col("rank").cast("int")).cast("int"), F.size(F.filter("upto", lambda c: c <= F.col("rank")))).alias("shard")
    placed = store.written(placed.select("a", "b", "n", shard), "placed")
    sharded = spread_join(rows, placed, ["a", "b"], ["doc_id"]).withColumn("key", F.pmod(F.xxhash64("doc_id", "a"), F.lit(SPAN)))
    return running(store.written(sharded, "sharded"), "shard", "key", ["doc_id", "size"], F.lit(1), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_shards(spark, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
