"""Trie of conversation prefixes: which conversations share their first turns,
and what encoding a shared turn once would save.

Every distinct sequence of a conversation's first d turns is a node; its owner
is the smallest conversation that begins with it, so a node is named by owner
and depth. A conversation that owns its first d turns owns every longer
prefix of its own too: what it owns is a chain from its first owned depth on,
and the chains, each hung below the node of its parent's owner, form the tree.

A prefix's digest is a running sum, over its turns, of 128 bits that depend on
a turn's place, role and text; sums of parts add up, so a conversation of any
length is summed in blocks of ``block`` depths, each a group of its own. Nodes
that several conversations share, with the smallest of these, are the table of
minima. Blocks are searched by halves: each round joins one digest of every
block that is still open with the minima and keeps the half that holds the
first owned depth. Joins with minima split heavy keys.

Chains are summed bottom-up by doubling: each adds to the chain 2 ** k levels
above it what it has gathered from below, so a tree of height h takes log h
rounds, whatever its shape. Nodes then take sums along their chain.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import numbered, running_sums, spread_join
from . import store


@dataclass(frozen=True)
class TrieRules:
    #: Depths of a block, a group of one task.
    block: int = 256


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, h, bytes) of each turn, in order; written."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the length of the role keeps ("ab", "c") and ("a", "bc") apart
    h = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", h.alias("h"), F.octet_length(text).cast("long").alias("bytes"))
    placed = numbered(store.written(rows, "turns"), ["conv_id"], ["turn", "h"], "pos")
    return store.written(placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "h", "bytes"), "placed")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, depth, h, bytes): of each conversation the first ``head`` turns
    of conversation ``base`` and then its own after as many, and a row of depth
    0. ``base`` and ``head``, at most ``most``, are expressions on conv_id."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("base", base).withColumn("head", head)
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    plan = store.written(convs.join(sizes, "base", "left").select("conv_id", "base", "head", "own", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("taken")), "plan")
    heads = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "h", "bytes")
    first = plan.join(heads, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "h", "bytes")
    kept = spread_join(turns, plan.select("conv_id", "head", "taken", "own"), ["conv_id"], ["pos"], n="own").where("pos > head")
    rest = kept.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "h", "bytes")
    roots = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("h"), F.lit(0).cast("long").alias("bytes"))
    return roots.unionByName(first).unionByName(rest)


def prefixes(turns: DataFrame, rules: TrieRules) -> DataFrame:
    """(conv_id, depth, block, a, b, bytes): the digest (a, b) of each prefix."""
    at = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.col("h")))
    # four numbers of 32 bits, whose sums stay below 2 ** 63
    parts = {f"p{k}": F.coalesce(F.conv(F.substring(at, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(0)) for k in range(4)}
    block = F.floor(F.col("depth") / rules.block).cast("long")
    rows = store.written(turns.withColumns(parts).drop("h"), "rebuilt")
    upto = running_sums(rows.withColumnsRenamed({p: f"_{p}" for p in parts}), "conv_id", block, ["depth"], {p: F.col(f"_{p}") for p in parts})
    sums = [F.when(F.col("depth") > 0, F.col(p) + F.col(f"_{p}")).otherwise(0) for p in parts]
    return store.written(upto.select("conv_id", "depth", block.alias("block"), F.xxhash64("depth", *sums).alias("a"), F.xxhash64(F.lit("second"), "depth", *sums).alias("b"), "bytes"), "prefixes")


def searched(pre: DataFrame, shared: DataFrame, total: int, rules: TrieRules) -> DataFrame:
    """(conv_id, block, found, above, above_depth): of each block the first
    depth that its conversation owns, null if none, and the owner of the last
    prefix before it within the block, null if that is in another block."""
    digest = F.struct("depth", "a", "b")
    state = pre.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(digest)).alias("open"))
    state = state.withColumn("above", F.struct(F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("long").alias("owner"))).withColumn("found", F.lit(None).cast("long"))
    minima = shared.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "owner", "n")
    for _ in range(math.ceil(math.log2(rules.block + 1))):
        half = F.floor(F.size("open") / 2).cast("int")
        middle = F.get("open", half)
        probes = state.withColumn("half", half).withColumn("at", middle.depth).withColumn("pa", middle.a).withColumn("pb", middle.b)
        met = spread_join(probes, minima, ["pa", "pb"], ["conv_id", "block"], "left", total=total)
        open_ = F.size("open") > 0
        mine = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))  # what nobody shares is its own
        state = met.select(
            "conv_id", "block",
            F.when(open_ & mine, F.slice("open", 1, F.col("half"))).when(open_, F.slice("open", F.col("half") + 2, F.size("open"))).otherwise(F.col("open")).alias("open"),
            F.when(open_ & ~mine, F.struct(F.col("at").alias("depth"), F.col("owner").alias("owner"))).otherwise(F.col("above")).alias("above"),
            F.when(open_ & mine, F.col("at")).otherwise(F.col("found")).alias("found"),
        )
    return state.select("conv_id", "block", "found", F.col("above.owner").alias("above"), F.col("above.depth").alias("above_depth"))


def streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, depth, ends_sha256) from (owner, depth, conv_id) in order: the
    SHA-256 sum of the comma-joined ids, fed batch by batch, so that a node
    where any number of conversations end needs no list of them."""
    now, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in done], pa.int64()), pa.array([x[0][1] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["owner", "depth", "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        owner, depth = (np.asarray(batch.column(k)) for k in (0, 1))
        ids = pc.cast(batch.column(2), pa.string()).to_pylist()
        cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(depth) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            key = (int(owner[i]), int(depth[i]))
            piece = ",".join(ids[i:j]).encode()
            if key == now:
                state.update(b"," + piece)
            else:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece)
        if done:
            yield flush()
            done = []
    if state is not None:
        done.append((now, state.hexdigest()))
        yield flush()


def subtree_sums(chains: DataFrame) -> DataFrame:
    """(conv_id, parent, hung, leaves, saved): with what all chains below have,
    from (conv_id, parent, hung, leaves, saved) of each chain alone."""
    state = store.written(chains.withColumn("jump", F.col("parent")), "chains")
    while True:
        # what the chains whose jump leads here have gathered
        given = store.written(state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n")), "given")
        total = given.agg(F.sum("n")).first()[0]
        if not total:
            return state.drop("jump")
        ends = state.where("jump IS NOT NULL").select(F.col("conv_id").alias("jump"), F.col("jump").alias("further"))
        targets = given.select(F.col("conv_id").alias("jump"), "n").join(ends, "jump", "left")
        gained = state.join(given.drop("n"), "conv_id", "left")
        summed = gained.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
        state = store.written(spread_join(summed, targets, ["jump"], ["conv_id"], "left", total=total).withColumn("jump", F.col("further")).drop("further"), "chains")


def trie(conversations: DataFrame, base: Column, head: Column, most: int, rules: TrieRules = TrieRules()) -> DataFrame:
    """A row per node: conv_id (owner), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns that tie, by a hash of role
    and text, so rows that repeat each other are turns each. Null roles and
    texts are empty. Rows without conv_id belong to no conversation. Texts of
    any length are hashed where they are read and don't move. An empty table
    gives an empty result, without a root. Other columns are ignored.
    """
    pre = prefixes(rebuilt(turns_of(conversations), base, head, most), rules)
    counts = pre.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"))
    shared = store.written(counts.where("n > 1"), "minima")
    total = pre.count()
    blocks = store.written(searched(pre, shared, total, rules), "blocks")
    lengths = pre.groupBy("conv_id").agg(F.max("depth").alias("last"))
    firsts = blocks.groupBy("conv_id").agg(F.min("found").alias("first"), F.max_by("above", "above_depth").alias("above"))
    convs = store.written(firsts.join(lengths, "conv_id"), "convs")  # above: who owns the last prefix that isn't the conversation's own
    # owned nodes: a block's depths from the first found on
    owned = pre.join(blocks.where("found IS NOT NULL").select("conv_id", "block", "found"), ["conv_id", "block"]).where("depth >= found").select("conv_id", "depth", "block", "bytes")
    sharing = shared.select(F.col("owner").alias("conv_id"), "depth", F.col("n").alias("n_convs"))
    nodes = owned.join(sharing, ["conv_id", "depth"], "left").withColumn("n_convs", F.coalesce("n_convs", F.lit(1)).cast("long"))
    nodes = store.written(nodes.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    chains = convs.where("first IS NOT NULL").select("conv_id", "first", "last", F.when(F.col("first") > 0, F.col("above")).alias("parent"), (F.col("first") - 1).alias("hung"))
    below = store.written(chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("hung").alias("depth")).agg(F.count("*").alias("hanging")), "below")
    inner = below.select("conv_id", F.col("depth").alias("last"), F.lit(0).cast("long").alias("leaves"))
    weights = nodes.groupBy("conv_id").agg(F.sum("own_saved").alias("saved"))
    alone = chains.join(inner, ["conv_id", "last"], "left").join(weights, "conv_id").select("conv_id", "parent", "hung", F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), "saved")
    sums = subtree_sums(alone)
    hung = sums.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("hung").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"), F.count("*").alias("hanging"))
    ends = convs.select(F.when(F.col("first").isNotNull(), F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("last").alias("depth"), "conv_id")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = ends.repartition(parts, "owner", "depth").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(streamed_hashes, "owner long, depth long, ends_sha256 string")
    met = nodes.join(hung, ["conv_id", "depth"], "left").join(hashed.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left")
    ending = spread_join(met, chains.select("conv_id", "first", "last", "parent", (F.col("last") - F.col("first") + 1).alias("n")), ["conv_id"], ["depth"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    children = zero("hanging") + (F.col("depth") < F.col("last")).cast("long")
    full = store.written(ending.select(
        "conv_id", "depth", "block", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        (zero("hung_leaves") + (children == 0).cast("long")).alias("_leaves"), (F.col("own_saved") + zero("hung_saved")).alias("_saved"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ), "full")
    deeper = running_sums(full, "conv_id", -F.col("block"), [F.desc("depth")], {"n_leaves": F.col("_leaves"), "saved_tokens": F.col("_saved")})
    return deeper.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"), "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8)


OP12_SQL = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))) AS v FROM range(256) AS r(i))),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT for x in string_split(conv_id::VARCHAR, '')]), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)::INT])), 4294967295::UBIGINT)::BIGINT % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1),
rb AS (SELECT h.conv_id, pos AS d, x FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND pos <= h
  UNION ALL SELECT conv_id, pos - h + least(h, coalesce(n.n, 0)), x FROM t JOIN h USING (conv_id) LEFT JOIN n ON base = conv_id - conv_id % 5 WHERE pos > h),
s AS (SELECT h.conv_id, coalesce(list(x ORDER BY d) FILTER (d IS NOT NULL), []) AS s FROM h LEFT JOIN rb USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, d, len(s) AS last, s[1:d] AS k FROM s, unnest(range(0, len(s) + 1)) AS u(d)),
node AS (SELECT k, d, min(conv_id) AS owner, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last), '') AS ends FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d > 0 THEN (node.n - 1) * strlen(k[d].t) ELSE 0 END AS saved FROM node LEFT JOIN kids USING (k, d)),
sub AS (SELECT k[1:e] AS k, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM full_, unnest(range(0, d + 1)) AS u(e) GROUP BY 1, 2)
SELECT f.owner AS conv_id, f.d AS depth, up.owner AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sub USING (k, d) LEFT JOIN node up ON up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]"""
