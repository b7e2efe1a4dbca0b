"""Byte-level BPE: encoding in overlapping chunks, decoding to raw bytes.

A text of at most ``chunk`` characters is encoded where it lies. A longer one
is cut into chunks that overlap. Each chunk is pre-tokenised by itself, from
its first character on, so its first boundaries may be wrong; the pattern
looks at nothing before a match, so from the first boundary that it shares
with the chunk before it, all of its boundaries are right. Each chunk then
encodes the pre-tokens from there to where the next one takes over. Chunks
that share no boundary within the overlap (one pre-token is longer than that,
or runs of digits are counted from different places) are joined to one larger
chunk, which is pre-tokenised anew and must meet its own neighbours; this goes
on until all seams are met. So only the surroundings of a lost seam come
together; where ``ROUNDS`` rounds don't settle a text, its rest does.

Only texts beyond ``chunk`` are shuffled. The tiktoken library encodes a whole
text, or, where chunks are stitched, one pre-token at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class Tokenizer:
    """A rank file on a path that all executors have, and the pattern that
    splits text before the merges."""

    ranks: str
    pattern: str


#: Distinct pre-tokens that a worker keeps; the cache starts anew beyond that.
CACHE = 200_000
#: Characters of a chunk, and how many of them it shares with the next one.
CHUNK, OVERLAP = 16_384, 512
#: Rounds in which chunks around lost seams are joined, before all that follows one is.
ROUNDS = 4


class Codec:
    """What a worker needs to encode and decode."""

    def __init__(self, tokenizer: Tokenizer):
        import tiktoken

        with open(tokenizer.ranks, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(tokenizer.pattern)
        encoding = tiktoken.Encoding("ranks", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.decode = encoding.encode_ordinary, encoding.decode_bytes
        self.known: dict[str, list[int]] = {}

    def ids(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = self.encode(piece)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))


@functools.lru_cache(maxsize=2)
def codec(tokenizer: Tokenizer) -> Codec:
    return Codec(tokenizer)


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>): a row per input row.

    Null and empty texts have no ids; null ids of rows and repeated rows are
    kept as they are; an empty table gives an empty result. Other columns are
    ignored.
    """
    rows, short = texts_of(docs, id_col, text_col, chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for batch in batches:
            for part in store.slices(batch):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists([code.encode(t) for t in texts])], ["doc_id", "ids"])

    encoded = rows.where(short).mapInArrow(whole, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")
    return encoded.unionByName(stitched(rows.where(~short), tokenizer, chunk, overlap))


def texts_of(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, Column]:
    """(doc_id, text) of each row, and whether the text is a single chunk."""
    store.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), F.length("text") <= chunk


def stitched(texts: DataFrame, tokenizer: Tokenizer, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of the rows of ``texts`` (doc_id, text), by their chunks."""
    id_type = dict(texts.dtypes)["doc_id"]
    # the number of a row tells repeated rows apart; it is fixed once the chunks are written
    long = texts.withColumn("row", F.monotonically_increasing_id())
    step = chunk - overlap
    columns = f"doc_id {id_type}, row long, n int, at int, part string, more boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, at in enumerate(range(0, max(1, len(text) - overlap), step)):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "row": row, "n": n, "at": at, "part": text[at : at + chunk], "more": at + chunk < len(text)}], schema=chunk_type(batch.schema.field("doc_id").type))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = codec(tokenizer).pattern
        for batch in batches:
            heads, tails = [], []
            for at, part, more in zip(*(batch.column(c).to_pylist() for c in ("at", "part", "more")), strict=True):
                found = [m.start() for m in pattern.finditer(part)]
                found = found[:-2] if more else found  # the end of the chunk may have cut these
                heads.append([at + x for x in found if x < overlap])
                tails.append([at + x for x in found if x >= len(part) - overlap] if more else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(heads), lists(tails)], [*batch.schema.names, "head", "tail"])

    def bounded(chunks: DataFrame, name: str) -> DataFrame:
        return store.written(chunks.mapInArrow(bounds, columns + ", head array<int>, tail array<int>"), name)

    chunks = store.written(long.select("doc_id", "text", "row").mapInArrow(cut, columns), "chunks")
    parts = bounded(chunks.repartition("row", "n"), "bounds")
    for k in range(ROUNDS + 1):
        seams = store.written(seams_of(parts), "seams")
        if seams.where("lost").isEmpty():
            break
        parts = bounded(joined_parts(parts, seams, to_the_end=k == ROUNDS - 1), "bounds")
    runs = parts.select("doc_id", "row", "n", "at", "part").join(seams.select("row", "n", "start", "stop"), ["row", "n"]).withColumnRenamed("n", "run")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for batch in batches:
            out = []
            for text, at, start, stop in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "start", "stop")), strict=True):
                out.append(code.ids([m[0] for m in code.pattern.finditer(text, start - at) if stop is None or m.start() < stop - at]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "run")] + [lists(out)], ["doc_id", "row", "run", "ids"])

    encoded = runs.mapInArrow(pieces, f"doc_id {id_type}, row long, run int, ids array<int>")
    joined = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "ids"))), lambda x: x.ids)).alias("ids"))
    return joined.select("doc_id", "ids")


def seams_of(parts: DataFrame) -> DataFrame:
    """(row, n, at, next_at, start, stop, lost): where each chunk's own
    pre-tokens begin and end; a chunk is lost if it meets the next one nowhere."""
    along = Window.partitionBy("row").orderBy("n")
    met = F.when(F.col("more"), F.array_min(F.array_intersect("tail", F.lead("head").over(along))))
    synced = parts.select("row", "n", "at", "more", "head", "tail").select("row", "n", "at", F.lead("at").over(along).alias("next_at"), met.alias("stop"), "more")
    return synced.select("row", "n", "at", "next_at", F.coalesce(F.lag("stop").over(along), F.lit(0)).alias("start"), "stop", (F.col("more") & F.col("stop").isNull()).alias("lost"))


def joined_parts(parts: DataFrame, seams: DataFrame, to_the_end: bool) -> DataFrame:
    """Chunks, those on either side of a lost seam joined; all that follow a
    text's first lost seam if ``to_the_end``."""
    along = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    apart = ~F.max("lost").over(along) if to_the_end else ~F.last("lost").over(along)
    first = F.when(F.coalesce(apart, F.lit(True)), F.col("n"))
    places = seams.select("row", "n", "next_at", first.alias("first"))
    places = places.select("row", "n", "next_at", F.last("first", True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    whole = Window.partitionBy("row", "first")
    places = places.withColumn("final", F.col("n") == F.max("n").over(whole))
    own = F.when(F.col("final"), F.col("part")).otherwise(F.expr("substring(part, 1, next_at - at)"))
    met = parts.select("doc_id", "row", "n", "at", "part", "more").join(places, ["row", "n"])
    ordered = F.sort_array(F.collect_list(F.struct("n", own.alias("own"))))
    return met.groupBy("row", "first").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.array_join(ordered["own"], "").alias("part"), F.max_by("more", "n").alias("more")).select("doc_id", "row", F.col("first").alias("n"), "at", "part", "more")


def chunk_type(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", doc_id), ("row", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("part", pa.string()), ("more", pa.bool_())])


def lists(values: list[list[int]]) -> pa.Array:
    import numpy as np

    offsets = np.zeros(len(values) + 1, "int32")
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(values), "int32", count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    """The bytes of a list of ids, one after another; null for null."""

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(tokenizer)
        for batch in batches:
            yield pa.array([None if x is None else code.decode(x.values.to_numpy().tolist()) for x in batch], pa.binary())

    return joined(ids)


def public_tokenizer() -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids of each text,
    and of the bytes that they decode to; and the ids, if asked for. Made in
    Python: a string for each id would fill the JVM's heap.

    A row per input row: null and empty texts have no tokens and the digests
    of nothing; null ids of rows and repeated rows are kept; very long texts
    are encoded in chunks; an empty table gives an empty result. Other columns
    are ignored.
    """
    rows, short = texts_of(docs, id_col, text_col, CHUNK)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def digested(code: Codec, doc_ids: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        sha256 = lambda data: hashlib.sha256(data).hexdigest()
        digest = [pa.array([sha256(" ".join(map(str, x)).encode()) for x in ids], pa.string()), pa.array([sha256(code.decode(x)) for x in ids], pa.string())]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), *digest, *([lists(ids)] if with_ids else [])], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for part in chain.from_iterable(map(store.slices, batches)):
            yield digested(code, part.column("doc_id"), [code.encode(t) for t in part.column("text").to_pylist()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for part in chain.from_iterable(map(store.slices, batches)):
            yield digested(code, part.column("doc_id"), [x.values.to_numpy().tolist() for x in part.column("ids")])

    kinds = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    # one worker a task: a second one, to digest what the first encodes, would hold the ranks once more
    return rows.where(short).mapInArrow(whole, kinds).unionByName(stitched(rows.where(~short), tokenizer, CHUNK, OVERLAP).mapInArrow(joined, kinds))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
