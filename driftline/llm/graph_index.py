"""Nearest neighbours by inner product: sharded, robust-pruned directed graphs.

Rows are dealt into shards of about ``shard_rows`` by a hash of their id, so
neither clusters nor copies of one vector make a large shard. Each shard gets
a graph of its own: points enter in growing batches; a greedy beam search in
the graph so far proposes neighbours of each; relaxed distance pruning keeps
few and diverse ones; reverse edges are added, and pruned where a list is
full. Equal vectors of a shard are one point.

The index is a table with one row per shard, written to the shared folder.
Queries are packed into blocks, and a copy of each block goes to every shard.
A task loads a shard once and streams its blocks through it, by a beam search
from the shard's centre; with very many blocks, waves of ``wave`` blocks make
tasks of their own, each with the shard loaded once. What is found is scored
in double precision on the original vectors, and the best of all shards are
ranked per query.

Largest inner product is nearest by distance once each vector has one more
component that lifts it to the shard's greatest norm; queries have 0 there.
Searches run in single precision on vectors scaled by the shard's greatest
component, so that huge values don't overflow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class GraphRules:
    #: Expected rows of a shard.
    shard_rows: int = 8_192
    #: Edges that pruning leaves; a list may grow to twice as many in between.
    degree: int = 24
    #: An edge goes if a kept one is ``relax`` times nearer to its end.
    relax: float = 1.2
    build_beam: int = 48
    search_beam: int = 160
    #: Most points that enter a graph at once.
    batch: int = 256
    #: Queries searched in step.
    block: int = 512
    #: Blocks that one task streams through a shard.
    wave: int = 64


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarity) of the ``beam`` best points found for each query, in
    no order; missing ones have the id len(points) and -inf. Every query
    expands its ``wide`` best unexpanded points in each step."""
    n, q = len(points), len(queries)
    ids = np.full((q, beam), n, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, queries @ points[entry], False
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    seen[:, entry] = True
    live = np.arange(q)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
        usable = np.take_along_axis(open_sims, pick, 1) > -np.inf
        more = usable.any(axis=1)
        live, pick, usable = live[more], pick[more], usable[more]
        if not len(live):
            break
        chosen = np.where(usable, ids[live[:, None], pick], n)
        done[live[:, None], pick] = True
        near = np.where(chosen[:, :, None] < n, graph[np.minimum(chosen, n - 1)], n).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        found = near[row, col]
        seen[live[row], found] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[row, col] = np.einsum("ij,ij->i", points[found], queries[live[row]])
        all_ids = np.concatenate([ids[live], np.where(fresh, near, n)], axis=1)
        all_sims = np.concatenate([sims[live], new], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    return ids, sims


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Out-neighbours (len(of), degree) picked from ``candidates``: the nearest
    first; each one kept removes those that it is ``relax`` times nearer to.
    The id len(points) stands for none. All points have one norm."""
    n = len(points)
    vectors = points[np.minimum(candidates, n - 1)]
    alive = (candidates < n) & (candidates != of[:, None])
    # squared distances, up to the factor 2
    norm = float((points[0] * points[0]).sum()) if n else 0.0
    to_of = norm - np.einsum("bcd,bd->bc", vectors, points[of])
    between = norm - vectors @ vectors.transpose(0, 2, 1)
    out = np.full((len(of), degree), n, np.int32)
    rows = np.arange(len(of))
    for k in range(degree):
        dist = np.where(alive, to_of, np.inf)
        pick = dist.argmin(axis=1)
        some = np.isfinite(dist[rows, pick])
        if not some.any():
            break
        out[some, k] = candidates[rows, pick][some]
        alive &= relax * relax * between[rows, pick] > to_of
        alive[rows, pick] = False
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In single precision, with components of at most 1. The order of inner
    products is that of the vectors themselves."""
    top = np.abs(vectors).max(initial=0.0)
    return (vectors / top if top else vectors).astype(np.float32)


def build_graph(vectors: np.ndarray, rules: GraphRules) -> tuple[np.ndarray, int]:
    """(graph, entry): neighbours of each point, len(vectors) for none, and the
    point nearest to the mean. ``vectors`` are distinct."""
    n = len(vectors)
    vectors = scaled(vectors)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    lift = np.sqrt(np.maximum(squares.max() - squares, 0))
    points = np.concatenate([vectors, lift[:, None]], axis=1).astype(np.float32)
    width = 2 * rules.degree
    graph = np.full((n, width), n, np.int32)
    entry = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(rules.batch, max(1, at))]
        at += len(batch)
        ids, _ = beam_search(points, graph, entry, points[batch], rules.build_beam)
        # points of one batch may be neighbours too, and don't find each other
        peers = points[batch] @ points[batch].T
        np.fill_diagonal(peers, -np.inf)
        nearest = batch[np.argsort(-peers, axis=1)[:, : min(8, len(batch) - 1)]].astype(np.int32)
        kept = robust_prune(points, batch, np.concatenate([ids, nearest], axis=1), rules.degree, rules.relax)
        graph[batch, : rules.degree] = kept
        graph[batch, rules.degree :] = n
        _add_reverse(points, graph, np.repeat(batch, rules.degree), kept.ravel(), rules)
    return graph, entry


def _add_reverse(points: np.ndarray, graph: np.ndarray, ends: np.ndarray, starts: np.ndarray, rules: GraphRules) -> None:
    """Adds the edges starts -> ends; lists that overflow are pruned."""
    n, width = graph.shape
    real = starts < n
    starts, ends = starts[real], ends[real]
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order].astype(np.int32)
    owners, first, counts = np.unique(starts, return_index=True, return_counts=True)
    have = (graph[owners] < n).sum(axis=1)
    room = have + counts <= width
    place = np.arange(len(starts)) - np.repeat(first, counts) + np.repeat(have, counts)
    fits = np.repeat(room, counts)
    graph[starts[fits], place[fits]] = ends[fits]
    full = np.flatnonzero(~room)
    by_size = full[np.argsort(counts[full])]
    for part in np.array_split(by_size, math.ceil(len(by_size) / 512)) if len(by_size) else []:
        more = np.full((len(part), int(counts[part].max())), n, np.int32)
        for k, owner in enumerate(part):
            more[k, : counts[owner]] = ends[first[owner] : first[owner] + counts[owner]]
        candidates = np.concatenate([graph[owners[part]], more], axis=1)
        candidates.sort(axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
        graph[owners[part], : rules.degree] = robust_prune(points, owners[part], candidates, rules.degree, rules.relax)
        graph[owners[part], rules.degree :] = n


def usable(embedding: Column) -> Column:
    """Not null, not empty, finite in every component, and not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def element(df: DataFrame, column: str) -> str:
    """The type that vectors are kept in: float for floats, double for all
    other numbers."""
    return "float" if dict(df.dtypes)[column] == "array<float>" else "double"


KINDS = {"float": np.float32, "double": np.float64}


def shard_count(rows: DataFrame, rules: GraphRules) -> int:
    return max(1, math.ceil(rows.count() / rules.shard_rows))


INDEX = "dim int, shard int, entry int, ids binary, starts binary, vectors binary, graph binary"


def build_index(rows: DataFrame, rules: GraphRules, k: int) -> DataFrame:
    """A row per shard and dimension. ``rows``: (id long, embedding
    array<float or double>), usable ones only. A point keeps the ``k + 1``
    smallest ids that have its vector."""
    shards = shard_count(rows, rules)
    kind = KINDS[element(rows, "embedding")]

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        dim = key[0].as_py()
        flat = table.column("embedding").combine_chunks()
        vectors = np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)) + 0  # no -0
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        first, point = np.unique(vectors.view(f"V{vectors.itemsize * dim}").ravel(), return_index=True, return_inverse=True)[1:]
        by_point = np.argsort(point.ravel(), kind="stable")
        counts = np.bincount(point.ravel())
        rank = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        again = np.zeros(len(ids), bool)  # rows that repeat both id and vector
        again[1:] = (ids[by_point][1:] == ids[by_point][:-1]) & (rank[1:] > 0)
        by_point, owner = by_point[~again], np.repeat(np.arange(len(counts)), counts)[~again]
        counts = np.bincount(owner)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = by_point[rank <= k]
        starts = np.concatenate([[0], np.cumsum(np.minimum(counts, k + 1))]).astype(np.int32)
        points = vectors[first]
        graph, entry = build_graph(points, rules)
        row = {"dim": dim, "shard": key[1].as_py(), "entry": entry, "ids": ids[kept].astype(np.int64).tobytes(), "starts": starts.tobytes(), "vectors": points.tobytes(), "graph": graph.tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("entry", pa.int32()), *((c, pa.binary()) for c in ("ids", "starts", "vectors", "graph"))]))

    dealt = rows.select("id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, INDEX)


def pack_queries(queries: DataFrame, rules: GraphRules) -> DataFrame:
    """(dim, ids binary, vectors binary): up to ``block`` queries a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                flat = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ids = own.column("id").to_numpy()
                for at in range(0, len(ids), rules.block):
                    part = slice(at, at + rules.block)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[part].astype(np.int64).tobytes()]), pa.array([flat[part].tobytes()])], ["dim", "query_ids", "queries"])

    return queries.select("id", "embedding", F.size("embedding").alias("dim")).mapInArrow(pack, "dim int, query_ids binary, queries binary")


def search_index(index: DataFrame, queries: DataFrame, shards: int, rules: GraphRules, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each query
    but rows of its own id; ties go to the smaller id. ``shards``: their number
    in the index."""
    kind = KINDS[element(queries, "embedding")]
    width = 2 * rules.degree

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict | None = None
        for batch in batches:
            for x in batch.to_pylist():
                at = (x["dim"], x["shard"])
                if x["graph"] is not None:
                    points = np.frombuffer(x["vectors"], kind).reshape(-1, x["dim"])
                    shard = {"at": at, "points": points, "near": scaled(points), "graph": np.frombuffer(x["graph"], np.int32).reshape(-1, width), "entry": x["entry"], "ids": np.frombuffer(x["ids"], np.int64), "starts": np.frombuffer(x["starts"], np.int32)}
                elif shard is not None and shard["at"] == at:  # else no row of the shard has as many components
                    query_ids = np.frombuffer(x["query_ids"], np.int64)
                    wanted = np.frombuffer(x["queries"], np.float64).reshape(-1, x["dim"])
                    near = wanted / np.abs(wanted).max(axis=1, keepdims=True)
                    found, _ = beam_search(shard["near"], shard["graph"], shard["entry"], near.astype(np.float32), max(rules.search_beam, k + 1))
                    yield _best(found, shard["points"], shard["ids"], shard["starts"], query_ids, wanted, k)

    blocks = pack_queries(queries, rules)
    waves = max(1, math.ceil(queries.count() / (rules.block * rules.wave)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    loads = index.withColumn("wave", every(waves))
    asks = blocks.withColumn("wave", F.pmod(F.xxhash64("query_ids"), F.lit(waves)).cast("int")).withColumn("shard", every(shards))
    both = loads.unionByName(asks, allowMissingColumns=True).repartition("dim", "shard", "wave")
    # the shard itself comes before its blocks
    ordered = both.sortWithinPartitions("dim", "shard", "wave", F.col("graph").isNull())
    found = ordered.select("dim", "shard", "entry", "ids", "starts", "vectors", "graph", "query_ids", "queries").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def inner_products(points: np.ndarray, vector: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        scores = (points * vector).sum(axis=1)
        lost = ~np.isfinite(scores)
        if lost.any():  # beyond a double's range: the sign, or the value if only a part was
            by, top = np.abs(points[lost]).max(axis=1), np.abs(vector).max()
            scores[lost] = ((points[lost] / by[:, None]) * (vector / top)).sum(axis=1) * by * top
    return scores


def _best(found: np.ndarray, points: np.ndarray, ids: np.ndarray, starts: np.ndarray, query_ids: np.ndarray, wanted: np.ndarray, k: int) -> pa.RecordBatch:
    n = len(points)
    out: tuple[list, list, list] = ([], [], [])
    for row, query, vector in zip(found, query_ids, wanted, strict=True):
        own = row[row < n]
        scores = inner_products(points[own].astype(np.float64), vector)
        order = np.argsort(-scores, kind="stable")
        own, scores = own[order], scores[order]
        counts = starts[own + 1] - starts[own]
        enough = np.searchsorted(np.cumsum(counts), k + 1)  # of k + 1 ids one may be the query's
        last = scores[min(enough, len(scores) - 1)]
        own, scores, counts = (x[scores >= last] for x in (own, scores, counts))
        all_ids = np.concatenate([ids[starts[p] : starts[p + 1]] for p in own])
        all_scores = np.repeat(scores, counts)
        other = all_ids != query
        out[0].append(np.full(int(other.sum()), query))
        out[1].append(all_ids[other])
        out[2].append(all_scores[other])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, rules: GraphRules = GraphRules(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows, by inner
    product, of each row for which ``is_query`` holds.

    Rows without an id, and those whose vector is null, empty, zero or has
    null or non-finite components, take no part. Vectors of different lengths
    never meet. Equal vectors are all candidates, the smaller ids first. Rows
    that repeat an id and its vector are one row; those that repeat an id with
    another vector are candidates of their own, and the least vector is the
    query. Vectors of integers are taken as doubles. Scores beyond a double's
    range are infinite. An empty table gives an empty result. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    store.bounded_batches(spark)
    vector = F.col(vector_col).cast(f"array<{element(vectors, vector_col)}>")
    valid = vectors.where(F.col(id_col).isNotNull() & usable(vector))
    rows = valid.select(F.col(id_col).cast("long").alias("id"), vector.alias("embedding"))
    queries = store.written(valid.where(is_query).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector).alias("embedding")), "queries")
    index = store.written(build_index(rows, rules, k), "graphs")
    return search_index(index, queries, shard_count(rows, rules), rules, k)


def op1_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
