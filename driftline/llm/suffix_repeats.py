"""Passages that documents share: sparse suffix arrays.

A document is a row of words. Of its suffixes only those are retained that
start at a minimiser: the least k-mer of ``window`` neighbouring ones, which
the content alone selects. Every stretch of ``min_words`` words has a first
minimiser within its first ``window`` words; so the stretch has one anchor,
and at least ``core`` words of it lie to the anchor's right.

1. A retained suffix is first known by two hashes: of its ``core`` words, and
   of its context, ``min_words`` words to the right and ``window - 1`` to the
   left. Suffixes whose core is in no other document are dropped; contexts
   that several documents hold settle all of their stretches.
2. What is left, contexts of one document among others with the same core, is
   dealt out by the core and sorted word by word as a suffix array.
3. Neighbours are compared: how many words they share to the right in that
   order, and, sorted once more from the anchor outwards, to the left. For a
   stretch that starts ``o`` words left of its anchor, runs of neighbours that
   share ``min_words - o`` words to the right and ``o`` to the left hold it;
   so every stretch of a core is settled, for any number of contexts.
4. Only cores with more than ``max_core`` contexts would be large groups. Their
   stretches are counted by one hash for each, spread over all tasks. So a
   passage that a third of all documents hold, each with other words around
   it, is no hot group either, and none of its pairs are made.
5. Settled stretches go back to their documents, where they are united.

The result is exact, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from . import store
from .shingles import mixed, word_hashes


@dataclass(frozen=True)
class RepeatRules:
    #: Shortest passage, in words.
    min_words: int = 50
    #: Words of a k-mer.
    kmer: int = 6
    #: Neighbouring k-mers of which the least is retained.
    window: int = 24
    #: Contexts of one core that are sorted together.
    max_core: int = 4_096

    @property
    def core(self) -> int:
        """Words of a stretch that lie right of its anchor at least."""
        return self.min_words - self.window + 1


_FACTORS = np.random.default_rng(6_151).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def hashed_runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of ``words[i : i + length]`` for each i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += words[k : k + n] * _FACTORS[k]
    return mixed(total)


def anchors_of(words: np.ndarray, rules: RepeatRules) -> np.ndarray:
    """For each stretch of ``min_words`` words, by its start, its anchor: the
    place of the least k-mer among the first ``window``, the first of equals."""
    kmers = hashed_runs(words, rules.kmer)
    stretches = len(words) - rules.min_words + 1
    if stretches <= 0:
        return np.empty(0, np.int64)
    place = np.arange(len(kmers))
    # the least of 1, 2, 4, ... neighbours, then of two such runs that overlap
    size = 1
    while 2 * size <= rules.window:
        later = kmers[place[size:]] < kmers[place[:-size]]
        place = np.where(later, place[size:], place[:-size])
        size *= 2
    rest = rules.window - size
    if rest:
        later = kmers[place[rest:]] < kmers[place[:-rest]]
        place = np.where(later, place[rest:], place[:-rest])
    return place[:stretches]


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(text.encode("utf-8").split() if text else [])


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of ``words[i : i + length]`` for each start."""
    return mixed((np.lib.stride_tricks.sliding_window_view(words, length)[starts] * _FACTORS[:length]).sum(axis=1))


def context_hashes(words: np.ndarray, at: np.ndarray, rules: RepeatRules) -> np.ndarray:
    padded = np.concatenate([np.zeros(rules.window - 1, np.uint64), words, np.zeros(rules.min_words, np.uint64)])
    return run_hashes(padded, at, rules.window - 1 + rules.min_words).view(np.int64)


def offset_masks(first: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bit o for each stretch that starts o words before its anchor; the
    stretches of an anchor start one after another."""
    high = at - first
    return ((1 << (high + 1)) - (1 << (high - counts + 1))).astype(np.int32)


def retained(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(core, ctx, doc_id, text_id, at, offsets): the retained suffixes of each
    document. ``docs``: (doc_id, text_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "ctx", "doc_id", "text_id", "at", "offsets"]
        for batch in batches:
            parts: list[tuple] = []
            for doc_id, text_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "text")), strict=True):
                words = words_of(text)
                at, first, counts = np.unique(anchors_of(words, rules), return_index=True, return_counts=True)
                if len(at):
                    parts.append((run_hashes(words, at, rules.core).view(np.int64), context_hashes(words, at, rules), np.full(len(at), doc_id), np.full(len(at), text_id), at.astype(np.int32), offset_masks(first, counts, at)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    return docs.mapInArrow(find, "core long, ctx long, doc_id long, text_id long, at int, offsets int")


CONTEXT = "core long, ctx long, n long, large boolean, doc_id long, several boolean, right binary, left binary, offsets int"


def contexts(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """The contexts at each of ``places``, which has their core, n, large,
    several and offsets. ``right`` and ``left`` hold four bytes a word, the
    highest first, zeros beyond the text; ``left`` from the anchor outwards."""
    reach = rules.window - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                short = (words_of(text) >> np.uint64(32)).astype(">u4")
                padded = np.concatenate([np.zeros(reach, ">u4"), short, np.zeros(rules.min_words, ">u4")])
                for p in places:
                    i = p["at"] + reach
                    rows.append((p["core"], p["ctx"], p["n"], p["large"], doc_id, p["several"], padded[i : i + rules.min_words].tobytes(), padded[i - reach : i][::-1].tobytes(), p["offsets"]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in CONTEXT.split(", ")])

    return docs.mapInArrow(find, CONTEXT)


def neighbours(rows: DataFrame, rules: RepeatRules, at_once: int = 16_384) -> DataFrame:
    """(ctx, mask, n) of contexts that are sorted by core, then right. Bit o
    of ``mask``: the stretch at offset o is in another document too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                block = pa.Table.from_batches(held)
                core = block.column("core").to_numpy()
                other = np.flatnonzero(core != core[-1])  # the last core may go on
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from settled(block.slice(0, cut), rules)
                held, size = block.slice(cut).to_batches(), block.num_rows - cut
        if size:
            yield from settled(pa.Table.from_batches(held), rules)

    return rows.mapInArrow(compare, "ctx long, mask int, n long")


def common(words: np.ndarray) -> np.ndarray:
    """How many words each row shares, from the first on, with the row before."""
    differ = words[1:] != words[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])


def settled(block: pa.Table, rules: RepeatRules) -> Iterator[pa.RecordBatch]:
    """(ctx, mask, n) of whole cores in the order of their suffixes."""
    core, doc_id, offsets = (block.column(c).to_numpy() for c in ("core", "doc_id", "offsets"))
    several = block.column("several").to_numpy(zero_copy_only=False)
    words = lambda c, k: np.frombuffer(b"".join(block.column(c).to_pylist()), ">u4").reshape(-1, k)
    right, left = words("right", rules.min_words), words("left", rules.window - 1)
    size = len(core)
    new = np.concatenate([[True], core[1:] != core[:-1]])
    place = np.cumsum(new)
    outwards = np.lexsort([*left.T[::-1], place])
    start_right = np.concatenate([[0], common(right)])
    start_left = np.concatenate([[0], common(left[outwards])])
    new_left = np.concatenate([[True], place[outwards][1:] != place[outwards][:-1]])
    low, high = (np.where(several, x, doc_id) for x in (np.iinfo(np.int64).min, np.iinfo(np.int64).max))  # a context of several documents is unlike any other
    mask = np.zeros(size, np.int32)
    run_left = np.empty(size, np.int64)
    for o in range(rules.window):
        asks = (offsets >> o & 1).astype(bool)
        if not asks.any():
            continue
        run_right = np.cumsum(new | (start_right < rules.min_words - o))
        run_left[outwards] = np.cumsum(new_left | (start_left < o))
        order = np.lexsort([run_left, run_right])
        first = np.concatenate([[True], (run_right[order][1:] != run_right[order][:-1]) | (run_left[order][1:] != run_left[order][:-1])])
        begins = np.flatnonzero(first)
        apart = np.minimum.reduceat(low[order], begins) != np.maximum.reduceat(high[order], begins)
        hit = np.empty(size, bool)
        hit[order] = np.repeat(apart, np.diff(np.concatenate([begins, [size]])))
        mask |= (hit & asks).astype(np.int32) << o
    some = np.flatnonzero(mask)
    yield pa.RecordBatch.from_arrays([block.column("ctx").combine_chunks().take(pa.array(some)), pa.array(mask[some]), block.column("n").combine_chunks().take(pa.array(some))], ["ctx", "mask", "n"])


def stretches(rows: DataFrame, rules: RepeatRules) -> DataFrame:
    """(ctx, n, mask, stretch, doc_id, several): a row for each offset of each
    context; stretch is a hash of its words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out: list[tuple] = []
                for r in part.to_pylist():
                    right, left = np.frombuffer(r["right"], ">u4").astype(np.uint64), np.frombuffer(r["left"], ">u4").astype(np.uint64)
                    offsets = [o for o in range(rules.window) if r["offsets"] >> o & 1]
                    hashes = run_hashes(np.concatenate([left[::-1], right]), len(left) - np.array(offsets, np.int64), rules.min_words).view(np.int64)
                    out += [(r["ctx"], r["n"], 1 << o, h, r["doc_id"], r["several"]) for o, h in zip(offsets, hashes.tolist(), strict=True)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["ctx", "n", "mask", "stretch", "doc_id", "several"])

    return rows.mapInArrow(find, "ctx long, n long, mask int, stretch long, doc_id long, several boolean")


def united(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(doc_id, start, end, n_words) from (doc_id, found array<struct<at, mask>>),
    a row per text: stretches of it that overlap or touch are one passage."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                begins = np.array(sorted({x["at"] - o for x in found for o in range(rules.window) if x["mask"] >> o & 1}))
                gaps = np.flatnonzero(np.diff(begins) > rules.min_words)
                first, last = begins[np.concatenate([[0], gaps + 1])], begins[np.concatenate([gaps, [len(begins) - 1]])]
                ids += [doc_id] * len(first)
                starts += first.tolist()
                ends += (last + rules.min_words).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start", "end"])

    return docs.mapInArrow(unite, "doc_id long, start long, end long").withColumn("n_words", F.col("end") - F.col("start"))


def repeated_passages(docs: DataFrame, rules: RepeatRules = RepeatRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words): the passages of each document, in words,
    of which every stretch of ``min_words`` words is in another document too.
    Passages that touch or overlap are one.

    Documents without a repeat have no row; so have null and empty texts, and
    rows with a null id, which take no part. Rows that share an id are one
    document, so what only they repeat is no repeat; each of their texts has
    passages of its own, and rows with equal texts have one list. Words are
    compared as they are; white space isn't. Texts are read whole, however
    long. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_id"), F.col(text_col).alias("text"))
    suffixes = store.written(retained(rows, rules), "suffixes")
    twice = (F.min("doc_id") != F.max("doc_id")).alias("several")
    shared = store.written(suffixes.groupBy("core").agg(twice, F.count("*").alias("n")).where("several").select("core", "n"), "shared")
    found = store.written(spread_join(suffixes, shared, ["core"], ["doc_id", "at"], "left_semi", total=suffixes.count()), "found")
    store.drop(suffixes)
    # a context is one row from here on
    each = store.written(found.groupBy("core", "ctx").agg(twice, F.min(F.struct("doc_id", "text_id", "at")).alias("place"), F.bit_or("offsets").alias("offsets"), F.count("*").alias("n")), "contexts")
    cores = store.written(each.groupBy("core").agg(F.count("*").alias("contexts"), (~F.bool_and("several")).alias("alone")).where("alone").select("core", F.col("contexts").alias("_contexts"), (F.col("contexts") > rules.max_core).alias("large")), "cores")
    unsettled = spread_join(each, cores, ["core"], ["ctx"], n="_contexts", total=each.count()).select("place.doc_id", "place.text_id", F.struct("place.at", "core", "ctx", "n", "large", "several", "offsets").alias("p"))
    places = store.written(unsettled.groupBy("doc_id", "text_id").agg(F.collect_list("p").alias("places")), "places")
    # rows that repeat an id and a text give the same contexts again
    around = store.written(contexts(rows.join(places, ["doc_id", "text_id"]).select("doc_id", "text", "places"), rules), "around")
    ordered = around.where("NOT large").repartition("core").sortWithinPartitions("core", "right")
    settled_masks = neighbours(ordered, rules)
    counted = store.written(stretches(around.where("large"), rules), "stretches")
    again = counted.groupBy("stretch").agg((F.bool_or("several") | (F.min("doc_id") != F.max("doc_id"))).alias("twice"), F.count("*").alias("n")).where("twice").select("stretch", F.col("n").alias("_n"))
    late = spread_join(counted, store.written(again, "again"), ["stretch"], ["ctx"], "left_semi", n="_n", total=counted.count()).select("ctx", "mask", "n")
    parts = each.where("several").select("ctx", F.col("offsets").alias("mask"), "n").unionByName(settled_masks).unionByName(late)
    masks = store.written(parts.groupBy("ctx").agg(F.bit_or("mask").alias("mask"), F.max("n").alias("n")), "masks")
    for table in (shared, each, cores, places, around, counted):
        store.drop(table)
    hits = spread_join(found.withColumnRenamed("offsets", "asked"), masks, ["ctx"], ["doc_id", "at"], total=found.count()).select("doc_id", "text_id", "at", F.col("mask").bitwiseAND(F.col("asked")).alias("mask")).where("mask != 0")
    return united(hits.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("at", "mask")).alias("found")).select("doc_id", "found"), rules)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM w, unnest(range(0, len(w) - 49)) AS u(i) WHERE len(w) >= 50),
r AS (SELECT h FROM s GROUP BY h HAVING min(doc_id) != max(doc_id)),
b AS (SELECT DISTINCT doc_id, i FROM s WHERE h IN (SELECT h FROM r)),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM b),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g)
SELECT doc_id, min(i) AS start, max(i) + 50 AS "end", max(i) + 50 - min(i) AS n_words FROM k GROUP BY doc_id, run
"""
