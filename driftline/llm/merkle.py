"""Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf, the SHA-256 sum of its fields. The leaves of a group, in
order, are paired and hashed until one node is left, the group's subroot; the
subroots, in order, give the root in the same way. Hashes are lowercase
hexadecimal texts, and a node is the hash of its children's texts.

Leaves are numbered by a sort over ranges, so a group of any size is spread
over tasks. Aligned blocks of ``2 ** block_bits`` leaves are reduced where
they lie; a node for each block is left. While more of those are left than
``top_nodes``, they are reduced in blocks again; then the driver builds the
small top tree and broadcasts, for each block, the path from there to the
root. A second pass over the blocks gives each leaf its whole path, and proofs
and folds are column expressions on it.

A path is a text of 64 characters a level: the sibling's hash, or dashes where
a node has none. On which side a sibling stands follows from the leaf's place.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import numbered, spread_join
from . import store

NONE = b"-" * 64


@dataclass(frozen=True)
class TreeRules:
    #: Leaves of a block, as a power of two; a block is one group of a task.
    block_bits: int = 12
    #: So many nodes, of at most 1.2 kB each with their paths, may reach the driver.
    top_nodes: int = 8192


def levels_of(hashes: np.ndarray, most: int | None = None) -> list[np.ndarray]:
    """The levels of a tree over ``hashes`` (dtype S64), the lowest first:
    until one node is left, or exactly ``most`` levels up."""
    levels = [hashes]
    while len(levels[-1]) > 1 if most is None else len(levels) <= most:
        below = levels[-1].tolist()
        levels.append(np.array([hashlib.sha256(b"".join(below[i : i + 2])).hexdigest() for i in range(0, len(below), 2)], "S64"))
    return levels


def paths_of(levels: list[np.ndarray]) -> list[bytes]:
    """For each lowest node its siblings up to the highest level."""
    n, height = len(levels[0]), len(levels) - 1
    if not height:
        return [b""] * n
    out = np.full((n, height), NONE, "S64")
    at = np.arange(n)
    for k, level in enumerate(levels[:-1]):
        beside = at ^ 1
        there = beside < len(level)
        out[there, k] = level[beside[there]]
        at = at >> 1
    return out.view(f"S{64 * height}").ravel().tolist()


def _levels(table: pa.Table, bits: int) -> list[np.ndarray]:
    """The levels of a block; all of a group that is one block ends at its root."""
    alone = table.column("n")[0].as_py() <= 1 << bits
    return levels_of(np.array(table.column("hash").to_pylist(), "S64"), None if alone else bits)


def tree(nodes: DataFrame, rules: TreeRules) -> tuple[DataFrame, DataFrame]:
    """``nodes``: g (not null), pos (from 0, without gaps in g), n (nodes of g),
    hash, and other columns; a written table. Gives the nodes with ``path`` and
    ``root``, and a table (g, n, root)."""
    bits = rules.block_bits
    blocked = nodes.withColumn("block", F.shiftright("pos", bits))

    def reduced(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        return table.select(["g", "block", "n"]).slice(0, 1).append_column("top", pa.array([_levels(table, bits)[-1][0].decode()]))

    def with_paths(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        return table.append_column("low", pa.array(paths_of(_levels(table, bits)), pa.binary()).cast(pa.string()))

    narrow = blocked.select("g", "pos", "n", "hash", "block")
    blocks = store.written(narrow.groupBy("g", "block").applyInArrow(reduced, "g string, block long, n long, top string"), "blocks")
    whole = F.col("n") <= 1 << bits
    upper = blocks.where(~whole).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << bits)).alias("n"), F.col("top").alias("hash"))
    above, _ = top(upper, rules)
    above = above.select("g", F.col("pos").alias("block"), F.col("path").alias("high"), "root")
    # a row a block; written, so that what is above isn't made anew for paths and roots
    above = store.written(above.unionByName(blocks.where(whole).select("g", "block", F.lit("").alias("high"), F.col("top").alias("root"))), "above")
    if blocks.count() <= 2 * rules.top_nodes:
        above = F.broadcast(above)
    found = blocked.groupBy("g", "block").applyInArrow(with_paths, ", ".join(f"`{c}` {kind}" for c, kind in [*blocked.dtypes, ("low", "string")]))
    joined = found.join(above, ["g", "block"]).withColumn("path", F.concat("low", "high")).drop("block", "low", "high")
    sizes = blocks.where("block = 0").select("g", "n")
    return joined, sizes.join(above.where("block = 0").select("g", "root"), "g")


def top(nodes: DataFrame, rules: TreeRules) -> tuple[DataFrame, DataFrame]:
    """``tree`` of few nodes, built by the driver; of more, by blocks. Nodes
    have no other columns."""
    if nodes.count() > rules.top_nodes:
        return tree(nodes, rules)
    groups: dict[str, list] = {}
    for row in nodes.orderBy("g", "pos").collect():  # at most top_nodes
        groups.setdefault(row["g"], []).append(row["hash"])
    rows, roots = [], []
    for g, hashes in groups.items():
        levels = levels_of(np.array(hashes, "S64"))
        root = levels[-1][0].decode()
        roots.append((g, len(hashes), root))
        rows += [(g, pos, h, path.decode(), root) for pos, (h, path) in enumerate(zip(hashes, paths_of(levels), strict=True))]
    spark = nodes.sparkSession
    return spark.createDataFrame(rows, "g string, pos long, hash string, path string, root string"), spark.createDataFrame(roots, "g string, n long, root string")


def field(value: Column) -> Column:
    """The bytes that stand for a value: a dash for null, else its length in
    UTF-8, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(start: Column, pos: Column, path: Column) -> Column:
    """The root that ``start`` gives at place ``pos`` with the siblings of ``path``."""

    def up(node: Column, k: Column) -> Column:
        beside = F.substring(path, k * 64 + 1, F.lit(64))
        odd = F.call_function("shiftright", pos, k) % 2 == 1
        return F.sha2(F.when(beside.startswith("-"), node).when(odd, F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    height = F.floor(F.length(path) / 64).cast("int")
    return F.when(height > 0, F.aggregate(F.sequence(F.lit(0), height - 1), start, up)).otherwise(start)


def manifest(docs: DataFrame, fields: list[Column], group: Column, order: Column, tampered: Column | None = None, changed: list[Column] | None = None, rules: TreeRules = TreeRules()) -> DataFrame:
    """A row per input row: id (``order``), leaf, subroot, root, proof_sha256
    (of its siblings' hashes, level by level via the subroot to the root),
    folded_root (from the leaf of the fields ``changed`` where ``tampered`` is
    true, else of ``fields``, up the path of the original) and verified.

    Null fields are dashes; a null group is a group of its own, before all
    others; a null id comes first. Repeated rows are leaves each; rows of one
    id are ordered by leaf. Texts of any length are hashed as they are read and
    don't move. One leaf in one group is its own root; its proof is the hash of
    nothing. An empty table gives an empty result. Other columns of ``docs``
    are ignored.
    """
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(changed or fields))
    rows = docs.select(order.alias("id"), F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("g"), leaf(fields).alias("hash"), other.alias("other"))
    rows = store.written(rows, "leaves")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    placed = numbered(rows, ["g"], ["id", "hash"], "pos")
    placed = store.written(spread_join(placed, sizes.withColumn("rows", F.col("n")), ["g"], ["id", "hash"], n="rows"), "placed")
    found, subroots = tree(placed, rules)
    subroots = store.written(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "n", F.col("root").alias("hash")), "subroots")
    ordered = store.written(numbered(subroots, ["g"], ["of"], "pos"), "ordered")
    many = ordered.count()
    upper, _ = top(ordered.select("g", "pos", F.lit(many).cast("long").alias("n"), "hash"), rules)
    upper = upper.select("pos", "path", "root").join(ordered.select("pos", "of", "n"), "pos").select(F.col("of").alias("g"), F.col("pos").alias("pos_up"), F.col("path").alias("path_up"), F.col("root").alias("whole"), "n")
    joined = found.drop("n").join(F.broadcast(upper.drop("n")), "g") if many <= rules.top_nodes else spread_join(found.drop("n"), upper, ["g"], ["id", "hash"])
    again = folded(folded(F.coalesce("other", "hash"), F.col("pos"), F.col("path")), F.col("pos_up"), F.col("path_up"))
    siblings = F.translate(F.concat("path", "path_up"), "-", "")
    out = joined.select("id", F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1  # beyond the greatest long too
    changed = [one_more if c == "n_chars" else F.col(c) for c in names]
    return manifest(docs, [F.col(c) for c in names], F.col("lang"), F.col("doc_id"), tampered, changed).withColumnRenamed("id", "doc_id")


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text"))
OP13_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))) AS v FROM range(256) AS r(i))),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_LEAF.format(n="n_chars")}) AS leaf,
  CASE WHEN xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)::INT])), 4294967295::UBIGINT) % 7 = 0
    THEN sha256({_LEAF.format(n="(n_chars + 1::HUGEINT)")}) END AS other FROM documents, tab),
low AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv(g, k, i, h) AS (SELECT g, 0, pos, leaf FROM low
  UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM lv) WHERE n > 1 GROUP BY g, k, i // 2),
tops AS (SELECT g, max(k) AS height, arg_max(h, k) AS subroot FROM lv GROUP BY g),
mid AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS pos FROM tops),
up(k, i, h) AS (SELECT 0, pos, subroot FROM mid
  UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM up) WHERE n > 1 GROUP BY k, i // 2),
crown AS (SELECT max(k) AS height, arg_max(h, k) AS root FROM up),
steps AS (SELECT doc_id, low.leaf, low.pos, low.g, e AS k, CASE WHEN b.h IS NULL THEN '-' WHEN (low.pos >> e) & 1 = 1 THEN 'l' || b.h ELSE 'r' || b.h END AS s
    FROM low JOIN tops USING (g), unnest(range(0, height)) AS u(e) LEFT JOIN lv b ON b.g = low.g AND b.k = e AND b.i = xor(low.pos >> e, 1)
  UNION ALL SELECT doc_id, low.leaf, low.pos, low.g, 1000 + e, CASE WHEN b.h IS NULL THEN '-' WHEN (mid.pos >> e) & 1 = 1 THEN 'l' || b.h ELSE 'r' || b.h END
    FROM low JOIN mid USING (g), crown, unnest(range(0, crown.height)) AS u(e) LEFT JOIN up b ON b.k = e AND b.i = xor(mid.pos >> e, 1)),
paths AS (SELECT g, pos, list(s ORDER BY k) AS path FROM steps GROUP BY g, pos),
done AS (SELECT low.*, subroot, root, coalesce(path, []) AS path FROM low JOIN tops USING (g) CROSS JOIN crown LEFT JOIN paths USING (g, pos)),
again AS (SELECT *, list_reduce(list_prepend(coalesce(other, leaf), path), lambda x, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || x WHEN 'r' THEN x || s[2:] ELSE x END)) AS folded_root FROM done)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] for s in path], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM again"""
