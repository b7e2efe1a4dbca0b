"""Connected components of an edge table, by alternating large and small stars.

Each step moves edges towards the smallest node of their component, in joins
and aggregates only; the many edges of a star's centre are split over tasks.
Steps are written to the shared folder, which cuts the lineage, and are
counted as they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from . import store


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(both.where("v > u"), least, ["u"], ["v"], total=2 * n_edges).where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    # every edge (a, b) has a > b here
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least, ["a"], ["b"], total=n_edges).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is
    the smallest node reachable. Loops and repeated edges do no harm; an empty
    table gives none."""
    now, mark = _counted(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        large = _large_star(now, mark[0])
        new, new_mark = _counted(_small_star(large, mark[0]))
        store.drop(now)
        now, before, mark = new, mark, new_mark
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what is equal for equal sets of edges."""
    seen = Observation()
    marks = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0)).alias("x")]
    table = store.written(edges.observe(seen, *marks), "edges")
    found = seen.get
    return table, (found["n"], found["s"], found["x"])
