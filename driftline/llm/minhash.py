"""Near-duplicate documents: fast similarity sketches, banding, exact checks.

A sketch has ``BINS`` coordinates. In round ``i`` each shingle is hashed into
one bin; a bin keeps the least hash of the first round that reached it; from
round ``BINS`` on, a round fills one bin for sure, so every coordinate is
filled, in expected time n + BINS log BINS.

Documents with one set of shingles are one node from the start, so exact
copies cost nothing. Nodes meet in buckets of equal bands. First each bucket
links its nodes to its smallest node. Most buckets then are of one component.
In the others, only nodes outside of the bucket's largest component are still
compared with the rest: cells of at most a few hundred nodes are dealt over
all tasks. A cell first gets sketches alone; the nodes of it that come near to
another one then get their full sets, on which every link is checked. A pair
is looked at in the first band that it shares, and no pair is a row.

Copies of one text, members of one bucket or component, and a bucket's
smallest node may be a third of all rows; joins on them are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from . import store
from .components import components
from .shingles import mixed, shingle_set
from .text import text_key

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
_random = np.random.default_rng(7_919)
_SEEDS = _random.integers(1, 1 << 63, 2 * BINS, dtype=np.uint64)
_ROW = _random.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_NONE = np.uint64((1 << 64) - 1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: Nodes on each side of a cell.
CELL = 256
#: Equal coordinates from which on a pair is checked: 4.9 standard deviations
#: below those that pairs of similarity 0.75 have on average.
NEAR = BINS * 9 // 16


def sketch(elements: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a set that isn't empty. The chance that two
    sets share a coordinate is their Jaccard similarity."""
    out = np.full(BINS, _NONE)
    empty = np.ones(BINS, bool)
    for i in range(2 * BINS):
        hashes = mixed(elements ^ _SEEDS[i])
        if i < BINS:
            least = np.full(BINS, _NONE)
            np.minimum.at(least, (hashes >> _SHIFT).astype(np.intp), hashes)
            fresh = empty & (least != _NONE)
            out[fresh] = least[fresh]
            empty &= ~fresh
        elif empty[i - BINS]:
            out[i - BINS] = hashes.min()
            empty[i - BINS] = False
        if not empty.any():
            break
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS coordinates; its number is mixed in."""
    return mixed((coordinates.reshape(BANDS, ROWS) * _ROW).sum(axis=1) + _BAND).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): f1 and f2 stand for the whole set.
    Further columns of ``docs`` besides the text, longs all, come back."""
    further = [c for c in docs.columns if c not in ("doc_id", "text")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(store.slices, batches)):
            sizes, f1, f2, all_bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text)
                sizes.append(len(found))
                f1.append(fingerprint(found))
                f2.append(int(np.bitwise_xor.reduce(mixed(found + np.uint64(1))).view(np.int64)) if len(found) else 0)
                all_bands.append(bands(sketch(found)) if len(found) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in all_bands])]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_bands)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, *map(batch.column, further)], ["doc_id", "n_shingles", "f1", "f2", "bands", *further])

    return docs.mapInArrow(make, ", ".join(["doc_id long, n_shingles long, f1 long, f2 long, bands array<long>", *[f"{c} long" for c in further]]))


def fingerprint(elements: np.ndarray) -> int:
    """Stands for a whole set, in any order."""
    return int(mixed(elements).sum().view(np.int64)) if len(elements) else 0


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles binary, sketch binary): the fingerprint of each text's
    set, its sorted hashes, eight bytes each, and its sketch, four bytes a
    coordinate."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(store.slices, batches)):
            found = [shingle_set(text) for text in batch.column("text").to_pylist()]
            sketches = [sketch(x).astype(np.uint32).tobytes() if len(x) else b"" for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(fingerprint, found)), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(sketches, pa.binary())], ["node", "shingles", "sketch"])

    return docs.select("text").mapInArrow(make, "node long, shingles binary, sketch binary")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are similar. Many
    pairs may have one b. ``sets``: (node, shingles)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    many = pairs.groupBy("b").agg(F.count("*").alias("n"))
    hubs = store.written(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(many, "b"), "pair_hubs")
    # dealt out at every size: few pairs would be broadcast, and shuffles grow faster than the data
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    two = spread_join(one, hubs, ["b"], ["a"], total=pairs.count())
    return two.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def coordinates(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def compared(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between nodes of one bucket that differ in label.
    ``apart``, a written table: (g, band, node, label) of the buckets with
    several labels; ``sets``: (node, shingles, sketch). Nodes outside of a
    bucket's largest label meet all others, in cells."""

    def partners(coords: np.ndarray, i: int, members: np.ndarray, label: np.ndarray, band: int) -> np.ndarray:
        """Members of other labels that come near to i, the nearest first, and
        share no band with it before this one."""
        count = (coords[members] == coords[i]).sum(axis=1)
        near = np.flatnonzero((count >= NEAR) & (label[members] != label[i]))
        same = coords[members[near]].reshape(len(near), BANDS, ROWS) == coords[i].reshape(BANDS, ROWS)
        near = near[same.all(axis=2).argmax(axis=1) == band] if len(near) else near
        return members[near[np.argsort(-count[near], kind="stable")]]

    def look(key: tuple, cell: pa.Table) -> pa.Table:
        outer, label, coords = cell.column("outer").to_numpy(zero_copy_only=False), cell.column("label").to_numpy(), coordinates(cell.column("sketch"))
        wanted, members = np.zeros(len(label), bool), np.flatnonzero(~outer)
        for i in np.flatnonzero(outer):
            found = partners(coords, i, members, label, key[1].as_py())
            wanted[found] = True
            wanted[i] |= len(found) > 0
        return cell.drop_columns(["sketch"]).filter(pa.array(wanted))

    def compare(key: tuple, cell: pa.Table) -> pa.Table:
        outer, node, label, coords = cell.column("outer").to_numpy(zero_copy_only=False), cell.column("node").to_numpy(), cell.column("label").to_numpy().copy(), coordinates(cell.column("sketch"))
        full = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
        links: list[tuple] = []
        members = np.flatnonzero(~outer)
        for i in np.flatnonzero(outer):
            for j in partners(coords, i, members, label, key[1].as_py()):
                if label[j] != label[i] and similar(full[i], full[j], percent):
                    links.append((max(node[i], node[j]), min(node[i], node[j])))
                    label[label == label[i]] = label[j]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    counts = apart.groupBy("g", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy("g").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    top = store.written(top.select("g", "n", F.col("top.label").alias("top"), F.ceil(F.col("n") / CELL).alias("cells"), F.ceil((F.col("n") - F.col("top.n")) / CELL).alias("outer_cells")), "tops")
    placed = spread_join(apart, top, ["g"], ["node"], total=apart.count()).withColumn("h", F.xxhash64("node", "g"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = F.transform(every("outer_cells"), lambda o: F.struct(F.pmod("h", "cells").alias("m"), o.alias("o"), F.lit(False).alias("outer")))
    as_outer = F.when(F.col("label") != F.col("top"), F.transform(every("cells"), lambda m: F.struct(m.alias("m"), F.pmod("h", "outer_cells").alias("o"), F.lit(True).alias("outer"))))
    roles = F.concat(as_member, F.coalesce(as_outer, F.array().cast("array<struct<m:bigint,o:bigint,outer:boolean>>")))
    cells = placed.select("g", "band", "node", "label", F.explode(roles).alias("r")).select("g", "band", "node", "label", "r.*")
    near = cells.join(sets.select("node", "sketch"), "node").groupBy("g", "band", "m", "o").applyInArrow(look, "node long, g long, band int, label long, m long, o long, outer boolean")
    return store.written(near, "near").join(sets, "node").groupBy("g", "band", "m", "o").applyInArrow(compare, "a long, b long")


def linked(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the nodes that have a link. ``nodes``, a written
    table: (node, id, bands), one per set, with the id of a document that has
    it; ``docs``: (doc_id, text)."""
    groups = nodes.select(F.posexplode("bands").alias("band", "g"), "node", "id")
    hubs = store.written(groups.groupBy("g").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    members = store.written(spread_join(groups, hubs, ["g"], ["node"], total=BANDS * nodes.count()).select("g", "band", "node", "id", "hub"), "members")
    n_members = members.count()
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    wanted = members.select("node").distinct()
    # a document may have several rows, with texts that aren't wanted
    found = shingle_sets(docs.join(ids, "doc_id", "left_semi")).join(wanted, "node", "left_semi")
    sets = store.written(found.dropDuplicates(["node"]), "sets")
    star = store.written(members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "star")
    first = store.written(components(checked(star, sets, percent)), "first")
    labelled = store.written(members.select("g", "band", "node").join(first, "node", "left").select("g", "band", "node", F.coalesce("component", "node").alias("label")), "labels")
    several = labelled.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low != high").select("g", "n")
    apart = store.written(spread_join(labelled, store.written(several, "several"), ["g"], ["node"], "left_semi", total=n_members), "apart")
    more = compared(apart, sets, percent)
    # what the second links join are the components of the first
    label = first.withColumnRenamed("component", "label")
    ends = more.join(label.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a", "left").join(label.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b", "left")
    second = store.written(components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), "second")
    sizes = first.groupBy("component").agg(F.count("*").alias("n"))
    moved = second.select(F.col("node").alias("component"), F.col("component").alias("new")).join(sizes, "component")
    again = spread_join(first, store.written(moved, "moved"), ["component"], ["node"], "left", total=first.count())
    alone = second.join(first.select("node"), "node", "left_anti")
    return again.select("node", F.coalesce("new", "component").alias("component")).unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row per input row; with
    ``keyed`` also key_a and key_b, the ``text_key`` of the row's text.

    Documents without words, and rows with a null id, link with nothing: their
    component is their own id, and they are kept. Rows that repeat id and text
    have one class, and are kept all or none; rows that share an id with other
    texts are classed each by its own text. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = [text_key(F.col("text"))[x].alias(f"key_{x}") for x in ("a", "b") if keyed]
    signed = store.written(signatures(rows.select("*", *key)), "signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = store.written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    labels = linked(sets.select(F.col("f1").alias("node"), "id", "bands"), rows, percent)
    per_set = sets.drop("bands").join(labels.withColumnRenamed("node", "f1"), "f1", "left").withColumn("label", F.coalesce("component", "f1"))
    per_set = store.written(per_set.select("f1", "f2", "id", "label", F.col("n").alias("rows")), "per_set")
    least = store.written(per_set.groupBy("label").agg(F.min("id").alias("set_component"), F.count("*").alias("n")), "least")
    classes = store.written(spread_join(per_set, least, ["label"], ["f1"], total=sets.count()).select("f1", "f2", "set_component", F.col("rows").alias("n")), "classes")
    linkable = signed.drop("bands").withColumn("linkable", F.expr("n_shingles > 0 AND doc_id IS NOT NULL"))
    joined = spread_join(linkable, classes, ["f1", "f2"], ["doc_id"], "left")
    component = F.when(F.col("linkable"), F.col("set_component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *[f"key_{x}" for x in ("a", "b") if keyed])


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
