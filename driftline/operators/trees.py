"""Forests of binned trees, grown in numpy, all trees of all cells in one job.

Features are cut at quantiles of a cell's training rows, so rows of equal bins
are alike to every tree. They are counted once: a table of (bins, rows,
positives) for each fold. A bootstrap counts each row Poisson(1) times, hence n
alike rows Poisson(n) times: trees that are grown on the counts have the law of
trees that are grown on the rows, as MLlib grows them. The table has at most as
many rows as there are rows, or combinations of bins.

A task grows a few trees of one cell, level by level. It holds the cell's table
up to ``HELD`` rows, and else reads it in slices for each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..documents import opened
from ..shared import new_path

#: Rows of a table that a task holds, and reads at once.
HELD, SLICE = 8_000_000, 1 << 20
#: Trees that a task grows.
BLOCK = 10
NODES = "place int, tree int, id int, left int, right int, feature int, threshold double, p double"


def edges_of(df: DataFrame, columns: list[str], bins: int, folds: list[int], fold: str) -> dict[int, list[np.ndarray]]:
    """For each fold the thresholds of each feature: ``bins - 1`` quantiles of
    the rows of all other folds, without repeats."""
    shares = [k / bins for k in range(1, bins)]
    of = [F.percentile_approx(F.when(F.col(fold) != k, F.col(c)), shares, 10_000).alias(f"{k}_{i}") for k in folds for i, c in enumerate(columns)]
    row = df.agg(*of).first()  # bins - 1 numbers a feature and fold
    return {k: [np.unique(np.array(row[f"{k}_{i}"] or [], float)) for i in range(len(columns))] for k in folds}


def counted(df: DataFrame, columns: list[str], targets: list[str], edges: dict[int, list[np.ndarray]], fold: str) -> str:
    """Writes, for each fold, (key, n and p of each target) of the rows of the
    other folds, a key being a byte for each feature's bin; gives the path."""
    names = [x for t in range(len(targets)) for x in (f"n{t}", f"p{t}")]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(columns)
        for batch in batches:
            own = np.asarray(batch.column(0))
            x = [np.asarray(batch.column(1 + i)) for i in range(width)]
            y = [batch.column(1 + width + t).to_numpy(zero_copy_only=False).astype(float) for t in range(len(targets))]
            for k, cuts in edges.items():
                rows = own != k
                if not rows.any():
                    continue
                bins = np.column_stack([np.searchsorted(c, v[rows], "left") for c, v in zip(cuts, x, strict=True)]).astype(np.uint8)
                keys = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(np.arange(0, bins.size + 1, width, dtype=np.int32)), pa.py_buffer(bins.tobytes())])
                counts = [c for v in y for c in (~np.isnan(v[rows]), v[rows] == 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), k, np.int32)), keys, *(pa.array(c.astype(np.int64)) for c in counts)], ["part", "key", *names])

    rows = df.select(F.col(fold).cast("long"), *[F.col(c).cast("double") for c in columns], *[F.col(t).cast("double") for t in targets])
    found = rows.mapInArrow(binned, "part int, key binary, " + ", ".join(f"{n} long" for n in names))
    path = new_path(df.sparkSession, "binned")
    found.groupBy("part", "key").agg(*[F.sum(n).alias(n) for n in names]).sortWithinPartitions("part", "key").write.partitionBy("part").parquet(path)
    return path


class Entries:
    """The table of one cell in slices: bins, rows and positives."""

    def __init__(self, path: str, part: int, target: int, width: int):
        self.system, top = opened(path)
        found = self.system.get_file_info(fs.FileSelector(f"{top}/part={part}", allow_not_found=True))
        self.files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))
        self.columns, self.width = ["key", f"n{target}", f"p{target}"], width
        size = 0
        for file in self.files:
            with self.system.open_input_file(file) as f:
                size += pq.ParquetFile(f).metadata.num_rows
        self.held = list(self.read()) if size <= HELD else None

    def read(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for file in self.files:
            with self.system.open_input_file(file) as f:
                for batch in pq.ParquetFile(f).iter_batches(SLICE, columns=self.columns):
                    key, n, p = (batch.column(c) for c in self.columns)
                    bins = np.frombuffer(key.cast(pa.binary(self.width)).buffers()[1], np.uint8, len(key) * self.width, key.offset * self.width).reshape(-1, self.width)
                    yield bins, np.asarray(n), np.asarray(p)

    def drawn(self, seed: list[int]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """Twice the bin of each feature, class and number of the rows that a
        bootstrap draws; the same ones for the same seed."""
        for k, (bins, n, p) in enumerate(self.held if self.held is not None else self.read()):
            rng = np.random.default_rng([*seed, k])
            drawn = [rng.poisson(n - p), rng.poisson(p)]
            some = [np.flatnonzero(d) for d in drawn]
            every = np.concatenate(some)
            yield [2 * bins[every, f].astype(np.int64) for f in range(self.width)], np.repeat([0, 1], [len(s) for s in some]), np.concatenate([d[s] for d, s in zip(drawn, some, strict=True)]).astype(float)


def grown(entries: Entries, seed: list[int], weights: tuple[float, float], bins: int, depth: int, min_leaf: int) -> dict[str, np.ndarray]:
    """One tree: left, right (-1 in leaves), feature, bin (rows up to it go
    left) and p of its nodes. Gini impurity of weighted classes; a node looks at
    the root of all features, rounded up, and a leaf has ``min_leaf`` drawn rows."""
    width = entries.width
    left, right, feature, cut, p = ([np.array([v])] for v in (-1, -1, 0, 0, 0.0))
    rng = np.random.default_rng([*seed, 1 << 31])
    base, active = 0, 1  # the nodes of a level follow each other
    some = int(np.ceil(np.sqrt(width)))
    slices = [[b, y, w, np.zeros(len(y), np.int64)] for b, y, w in entries.drawn(seed)] if entries.held is not None else None

    def moved(b: list[np.ndarray], at: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Whether each entry goes right at its node."""
        f = feature[at]
        return (np.choose(f, b) if width < 32 else np.column_stack(b)[np.arange(len(f)), f]) > 2 * cut[at]

    def placed() -> Iterator[list[np.ndarray]]:
        """Slices with the place of each entry in this level; entries in leaves are left out."""
        if slices is not None:
            yield from slices
            return
        ls, rs, fs_, cs = (np.concatenate(a) for a in (left, right, feature, cut))
        for b, y, w in entries.drawn(seed):
            at = np.zeros(len(y), np.int64)
            for _ in range(depth):
                at = np.where(ls[at] >= 0, np.where(moved(b, at, fs_, cs), rs[at], ls[at]), at)
            own = at >= base
            yield [[v[own] for v in b], y[own], w[own], at[own] - base]

    for level in range(depth + 1):
        chosen = np.argsort(rng.random((active, width)), axis=1).argsort(axis=1) < some
        best, place, sums = np.zeros(active), np.full((active, 2), -1), np.zeros((active, 2))
        hist = np.zeros((width, active * bins * 2)) if level < depth else None
        for b, y, w, at in placed():
            first = at * (2 * bins) + y
            sums += np.bincount(at * 2 + y, w, active * 2).reshape(active, 2)
            for f in range(width if level < depth else 0):
                if some == width:
                    hist[f] += np.bincount(first + b[f], w, active * bins * 2)
                else:
                    own = np.flatnonzero(chosen[:, f][at])
                    hist[f] += np.bincount(first[own] + b[f][own], w[own], active * bins * 2)
        p[-1] = np.divide(sums[:, 1] * weights[1], sums @ np.array(weights), out=np.zeros(active), where=sums.sum(1) > 0)
        if level == depth:
            break
        gini = lambda c: 2 * c[..., 0] * c[..., 1] / np.maximum(c.sum(-1), 1e-300)  # noqa: E731  # impurity by weight
        for f in range(width):
            lefts = hist[f].reshape(active, bins, 2).cumsum(1)[:, :-1]
            rights = sums[:, None] - lefts
            gain = gini(sums * weights)[:, None] - gini(lefts * weights) - gini(rights * weights)
            gain[(lefts.sum(-1) < min_leaf) | (rights.sum(-1) < min_leaf) | ~chosen[:, f, None]] = 0
            at = gain.argmax(1)
            top = gain[np.arange(active), at]
            better = top > np.maximum(best, 1e-12 * sums.sum(1))
            best[better], place[better] = top[better], np.column_stack([np.full(active, f), at])[better]
        inner = place[:, 0] >= 0
        n = int(inner.sum())
        child = np.where(inner, base + active + 2 * (np.cumsum(inner) - 1), -1)
        left[-1], right[-1], feature[-1], cut[-1] = child, np.where(inner, child + 1, -1), np.maximum(place[:, 0], 0), place[:, 1]
        if not n:
            break
        if slices is not None:
            for s in slices:
                b, y, w, at = s
                right_of = moved(b, at, place[:, 0].clip(0), place[:, 1])
                own = np.flatnonzero(inner[at])
                s[:] = [v[own] for v in b], y[own], w[own], child[at[own]] - base - active + right_of[own]
        base, active = base + active, 2 * n
        for a, v in ((left, -1), (right, -1), (feature, 0), (cut, 0), (p, 0.0)):
            a.append(np.full(active, v))
    return {k: np.concatenate(a) for k, a in (("left", left), ("right", right), ("feature", feature), ("cut", cut), ("p", p))}


def fit(df: DataFrame, sets: dict[str, list[str]], targets: list[str], cells: list, rules, fold: str) -> DataFrame:
    """The nodes of each cell's forest (``NODES``), written; place is the cell's
    in ``cells``, and a feature's number that in its set."""
    spark = df.sparkSession
    folds = sorted({c.fold for c in cells})
    known = {}
    for name, columns in sets.items():
        edges = edges_of(df, columns, rules.bins, folds, fold)
        known[name] = (edges, counted(df, columns, targets, edges, fold), len(columns))
    wanted = [(c.name, c.fold, targets.index(c.target), c.weights) for c in cells]
    path = new_path(spark, "forests")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = entries = None
        for batch in batches:
            for at in batch.column(0).to_pylist():
                place, tree = divmod(at, rules.trees)
                name, part, target, weights = wanted[place]
                edges, table, width = known[name]
                if place != now:
                    now, entries = place, Entries(table, part, target, width)
                t = grown(entries, [rules.seed, place, tree], weights, rules.bins, rules.depth, rules.min_leaf)
                cuts = edges[part]
                thresholds = np.zeros(len(t["left"]))
                for f in range(width):
                    own = (t["left"] >= 0) & (t["feature"] == f)
                    thresholds[own] = cuts[f][t["cut"][own]]
                n = len(thresholds)
                ints = [np.full(n, place), np.full(n, tree), np.arange(n), t["left"], t["right"], t["feature"]]
                yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in ints), pa.array(thresholds), pa.array(t["p"])], ["place", "tree", "id", "left", "right", "feature", "threshold", "p"])

    blocks = len(cells) * -(-rules.trees // BLOCK)
    spark.range(0, len(cells) * rules.trees, 1, blocks).mapInArrow(grow, NODES).write.partitionBy("place").parquet(path)
    return spark.read.schema(NODES).parquet(path)
