"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame
functions only.

Each source's documents are shuffled by a hash and laid end to end; that
stream of words is cut into blocks of equal size. Slot ``k`` of the mix takes
the golden-ratio point ``k * g mod 1`` through the cumulative target weights
to a source; the ``r``-th slot of a source takes block ``r`` of its stream,
wrapping around at the end. So every prefix of the mix has nearly the target
shares, and no random generator is used.

Points are integers modulo 2**31, so reruns and other engines agree exactly.
Slots find their source by an equi-join on cells of the unit interval, and are
ranked within ranges of ``k``, never in one task per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .ranks import order_key, running
from .text import word_count

#: Points are k * STEP modulo POINTS: POINTS over the golden ratio, made odd.
POINTS, STEP = 1 << 31, 1327217885
#: Cells of the unit interval for the join of slots to sources.
CELL_BITS = 10
CELLS = 1 << CELL_BITS


@dataclass(frozen=True)
class MixRules:
    #: Weights of the sources in code point order, null last, repeating.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words per block.
    block: int = 128
    max_epochs: int = 3
    #: Slots ranked together.
    slot_range: int = 1 << 16


def targets(sizes: DataFrame, rules: MixRules) -> DataFrame:
    """(source, docs, source_size, target) from (source, docs, source_size).

    All sizes are shared out by weight; a source that would get more than
    ``max_epochs`` times its size gets that, and the excess goes to the others
    by weight until none is above. The fixed point: in the order of the level
    ``max_epochs * size / weight``, those below the common level are full.
    One row per source, so windows over all rows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*map(F.lit, rules.weights)), ((F.row_number().over(order) - 1) % len(rules.weights)).cast("int"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source")
    full_before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(rules.max_epochs))
    leveled = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight")).withColumn("all", F.sum("source_size").over(everything))
    # the level if this source and all above it are not full
    tried = leveled.withColumn("common", (F.col("all") - F.coalesce(F.sum("cap").over(full_before), F.lit(0.0))) / F.sum("weight").over(rest))
    fixed = tried.withColumn("common", F.max(F.when(F.col("level") >= F.col("common"), F.col("common"))).over(everything))
    target = F.when(F.col("level") <= F.col("common"), F.col("cap")).otherwise(F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))
    return fixed.select("source", "docs", "source_size", target.alias("target"))


def schedule(sources: DataFrame, rules: MixRules) -> DataFrame:
    """(slot, source, block, epoch): the mix, one row per slot. ``sources`` is
    what ``targets`` returns."""
    spark = sources.sparkSession
    # one number: how many slots
    slots = spark.range(0, int(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] + rules.block - 1) // rules.block).withColumnRenamed("id", "slot")
    upto = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = F.ceil(F.col("source_size") / rules.block).cast("long")
    high = F.round(F.sum("target").over(upto) / F.sum("target").over(everything) * POINTS).cast("long")
    parts = sources.where("source_size > 0").select("source", blocks.alias("blocks"), high.alias("high"))
    parts = parts.withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("high", F.col("source").isNull(), "source"))).where("low < high")
    cells = parts.withColumn("cell", F.explode(F.sequence(F.shiftright("low", 31 - CELL_BITS), F.shiftright(F.col("high") - 1, 31 - CELL_BITS))))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(POINTS)) * F.lit(STEP), F.lit(POINTS))
    taken = slots.select("slot", point.alias("point"), F.shiftright(point, 31 - CELL_BITS).alias("cell")).join(cells, "cell").where("low <= point AND point < high")
    ranged = taken.select("slot", "source", "blocks", F.floor(F.col("slot") / rules.slot_range).alias("range"))
    counts = ranged.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = counts.select("source", "range", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("slot")) - 1
    ranked = ranged.withColumn("inside", inside).alias("r").join(before.alias("b"), F.expr("r.source <=> b.source AND r.range = b.range"))
    rank = F.col("before") + F.col("inside")
    epochs = ranked.select("slot", F.col("r.source").alias("source"), F.pmod(rank, F.col("blocks")).alias("block"), F.floor(rank / F.col("blocks")).alias("epoch"))
    return epochs.where(F.col("epoch") < rules.max_epochs)


@dataclass(frozen=True)
class Mix:
    """``slots``: the schedule. ``pieces``: (row fields, source, block, words)
    for each document and block that overlap. ``documents``: a row per input
    row with size, source_size, target, taken and epochs, the words taken in
    each epoch."""

    slots: DataFrame
    pieces: DataFrame
    documents: DataFrame


def mix(docs: DataFrame, rules: MixRules = MixRules(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> Mix:
    """The mix of ``docs``.

    Null and empty texts have no words and are never taken. Null ids are
    allowed; they take their place by size. Repeated rows are documents of
    their own, told apart by their place in the stream; which of two equal
    rows has which place is left open, but the set of results is the same. An
    empty table gives an empty mix. Other columns are ignored unless named in
    ``keep``; those come back in ``documents``, unchanged, in a struct ``row``.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.struct(*keep).alias("row")] if keep else []))
    sized = store.written(sized.withColumn("key", order_key(F.col("doc_id"), F.col("size"))), "sizes")
    sources = store.written(targets(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), rules), "sources")
    # starts are fixed once they are written, even among rows that tie
    placed = store.written(running(sized, "source", "key", ["doc_id", "size"], F.col("size"), "start"), "starts")
    end = F.col("start") + F.col("size") - 1
    holes = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / rules.block), F.floor(end / rules.block))))
    overlap = F.least(end + 1, (F.col("block") + 1) * rules.block) - F.greatest(F.col("start"), F.col("block") * rules.block)
    pieces = holes.select("source", "block", "doc_id", "size", "start", overlap.alias("words"))
    slots = schedule(sources, rules)
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    p, t = pieces.alias("p"), times.alias("t")
    taken = p.join(t, F.expr("p.source <=> t.source AND p.block = t.block"), "left").select("p.*", F.coalesce("times", F.lit(0)).alias("times"))
    epoch = [F.sum(F.when(F.col("times") > e, F.col("words")).otherwise(0)) for e in range(rules.max_epochs)]
    # a start within a source belongs to one document with words, so no id is needed
    per_doc = taken.groupBy("source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.array(*epoch).alias("epochs"))
    d, n, s = placed.drop("key").alias("d"), per_doc.alias("n"), sources.alias("s")
    counted = d.join(n, F.expr("d.source <=> n.source AND d.start = n.start AND d.size > 0"), "left").select(
        "d.*", F.coalesce("n.taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("n.epochs", F.array_repeat(F.lit(0).cast("long"), rules.max_epochs)).alias("epochs")
    )
    documents = counted.alias("d").join(s, F.expr("d.source <=> s.source")).select(*[f"d.{c}" for c in counted.columns if c != "start"], "source_size", "target")
    return Mix(slots, pieces, documents)


def op7_mix(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || size::VARCHAR), 1, 8))::BIGINT // 4 AS key FROM d),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap, (SELECT sum(source_size) FROM s0)::DOUBLE AS total FROM s0),
s2 AS (SELECT *, cap / weight AS level FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS common FROM s2),
s4 AS (SELECT *, (SELECT max(common) FROM s3 WHERE level >= common) AS c FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN level <= c THEN cap ELSE coalesce(c * weight, cap) END AS target FROM s4),
s6 AS (SELECT *, ceil(source_size / 128.0)::BIGINT AS blocks, round(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () * 2147483648)::BIGINT AS high FROM s5 WHERE source_size > 0),
s7 AS (SELECT *, lag(high, 1, 0) OVER (ORDER BY high, source NULLS LAST) AS low FROM s6),
slots AS (SELECT i AS slot, i % 2147483648 * 1327217885 % 2147483648 AS point FROM range(0, ((SELECT sum(source_size) FROM s0)::BIGINT + 127) // 128) AS r(i)),
t AS (SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN s7 ON low <= point AND point < high),
times AS (SELECT source, rank % blocks AS block, count(*) AS n FROM t WHERE rank // blocks < 3 GROUP BY ALL),
pieces AS (SELECT source, start, size, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0),
taken AS (SELECT q.source, q.start, sum(n * (least(start + size, (q.block + 1) * 128) - greatest(start, q.block * 128)))::BIGINT AS taken
  FROM pieces q JOIN times ON q.source IS NOT DISTINCT FROM times.source AND q.block = times.block GROUP BY ALL)
SELECT p.doc_id, p.size, source_size, target, CASE WHEN p.size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken
FROM p JOIN s5 ON p.source IS NOT DISTINCT FROM s5.source LEFT JOIN taken ON p.source IS NOT DISTINCT FROM taken.source AND p.start = taken.start
"""
