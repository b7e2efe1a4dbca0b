"""WARC archives: writing, reading and revisit resolution.

Records are made and parsed in Arrow batches, each a gzip member of its own,
so that one can be read without those before it. Members are gathered up to a
number of bytes; Spark's text writer makes a file of each such piece, on any
file system that Spark reaches, and the binary reader brings the files back.
Only headers are shuffled by payload digest; the largest id per digest comes
from a partial aggregate, and joins on a digest or an original are split where
a third of all pages have one payload. Payloads move once, in compressed
files, when the deduplicated archive is written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from . import store

#: Compressed bytes from which on a file is closed; one record may go beyond.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

HEADER = "file string, place int, page_id {id}, record_id string, kind string, payload_bytes long, payload_digest string, refers_to_record string"


def record(kind: str, record_id: str, page_id, url: str | None, date: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A record without its last two line ends, which the writer puts after
    each row. A revisit has the HTTP header alone as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "").replace("\n", "")))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", HTTP_TYPE), ("Content-Length", str(len(block)))]
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode() + END.encode() + block


def member(data: bytes) -> bytes:
    """A record as a gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data + END.encode()) + pack.flush()


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof and at < len(view):
            parts.append(unpack.decompress(view[at : at + step]))
            at += len(view[at : at + step]) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, compressed by record or
    as a whole or not at all."""
    for text in members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while text.startswith(b"WARC/", at):
            head = text.index(END.encode(), at)
            lines = text[at:head].decode("utf-8").split("\r\n")[1:]
            fields = dict(line.split(": ", 1) for line in lines)
            begin = head + 4
            end = begin + int(fields["Content-Length"])
            yield fields, text[begin:end]
            at = end + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def files_of(records: Iterator[bytes], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of one row: the bytes of a file but for its last one, which the
    writer puts behind each row. That byte is 0: a member ends with its length
    in four bytes, the highest last; behind one of 16 MB or more stands an
    empty member."""
    held: list[bytes] = []
    size = 0
    for data in records:
        packed = member(data)
        held.append(packed if packed[-1] == 0 else packed + zlib.compress(b"", wbits=31))
        size += len(held[-1])
        if size >= file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["file"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["file"])


def save(files: DataFrame, path: str) -> None:
    """Writes each row of the binary column ``file`` as a file. The text writer
    puts bytes out as they are."""
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_responses(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes a response record for each row; null payloads are empty, null
    urls and ids leave out their header. Record ids are new random ones."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = payload or b""
                yield record("response", uuid.uuid4().urn, page_id, url, date, payload, digest_of(payload))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return files_of(records(batches), file_bytes)

    save(pages.select(id_col, url_col, F.col(payload_col).cast("binary")).mapInArrow(make, "file binary"), path)


def read(spark: SparkSession, path: str, id_type: str = "long", with_record: bool = False) -> DataFrame:
    """A row per record: where it lies (file, place), page_id, record_id,
    kind, payload_bytes, payload_digest, refers_to_record; and, if asked for,
    url, date and payload. Bytes and digest of a response are those of the
    payload read; those of a revisit are null until it is resolved."""
    extra = ", url string, date string, payload binary" if with_record else ""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for place, (fields, block) in enumerate(parse(data.as_py())):
                    kind = fields["WARC-Type"]
                    payload = block.split(END.encode(), 1)[1] if kind == "response" else None
                    row = [name.as_py(), place, fields.get("X-Page-Id"), fields["WARC-Record-ID"][1:-1], kind, None if payload is None else len(payload), None if payload is None else digest_of(payload), fields.get("WARC-Refers-To", "<>")[1:-1] or None]
                    rows.append([*row, fields.get("WARC-Target-URI"), fields["WARC-Date"], payload] if with_record else row)
                    size += len(block) if with_record else 0
                    if len(rows) == 256 or size > store.ARROW_BATCH_BYTES:
                        yield to_batch(rows, with_record)
                        rows, size = [], 0
                if rows:
                    yield to_batch(rows, with_record)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(load, HEADER.format(id="string") + extra)
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def to_batch(rows: list[list], with_record: bool) -> pa.RecordBatch:
    names = ["file", "place", "page_id", "record_id", "kind", "payload_bytes", "payload_digest", "refers_to_record"] + ["url", "date", "payload"] * with_record
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.string(), pa.string(), pa.binary()] * with_record
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names)


def originals(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(payload_digest, payload_bytes, page_id, record_id, n) of the record
    that stays a response for each payload of at least ``min_bytes``: the one
    with the largest page_id; of rows that repeat it, one. n: how many records
    have the payload."""
    large = headers.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = F.max(F.struct("page_id", "record_id")).alias("o")
    return large.groupBy("payload_digest", "payload_bytes").agg(first, F.count("*").alias("n")).select("payload_digest", "payload_bytes", "o.page_id", "o.record_id", "n")


def write_deduplicated(spark: SparkSession, source: str, path: str, id_type: str = "long", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes the archive in ``source`` again to ``path``, with a revisit
    record for each payload that another record has as its original. Files
    meet the list of their revisits, which is as bounded as they are, as they
    lie, compressed; records that are no responses stay as they are. Rows that
    repeat an id and payload are records of their own, one a response; null
    ids rank lowest; an archive without records gives one without."""
    headers = store.written(read(spark, source, id_type), "headers")
    o = originals(headers, min_bytes).select("payload_digest", "payload_bytes", F.col("record_id").alias("original"), "n")
    responses = headers.where("kind = 'response'").select("file", "place", "record_id", "payload_digest", "payload_bytes")
    revisits = spread_join(responses, store.written(o.where("n > 1"), "originals"), ["payload_digest", "payload_bytes"], ["record_id"], total=headers.count()).where("record_id != original")
    by_file = revisits.groupBy("file").agg(F.collect_list(F.struct("place", "original")).alias("revisits"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for data, found in zip(*batch.columns, strict=True):
                original = {x["place"]: x["original"] for x in found.as_py() or []}
                for place, (fields, block) in enumerate(parse(data.as_py())):
                    yield again(fields, block, original.get(place))

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return files_of(records(batches), file_bytes)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source).select(F.col("path").alias("file"), "content")
    save(files.join(by_file, "file", "left").select("content", "revisits").mapInArrow(fresh, "file binary"), path)
    store.drop(headers)


def again(fields: dict[str, str], block: bytes, original: str | None) -> bytes:
    """A record with fresh headers: a revisit of ``original``, if it has one."""
    if fields["WARC-Type"] != "response":
        return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields.items())]).encode() + END.encode() + block
    payload = block.split(END.encode(), 1)[1]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return record("revisit" if original else "response", fields["WARC-Record-ID"][1:-1], fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Date"], payload, digest, original)


def resolve(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an
    archive; revisits get bytes and digest from the responses they refer to,
    and nulls if those aren't there. A row per record: null ids, empty
    payloads and repeated pages come back as they are; an archive without
    records gives an empty result."""
    rows = store.written(read(spark, path, id_type), "resolved")
    responses, revisits = rows.where("kind = 'response'"), rows.where("kind = 'revisit'").select("page_id", "record_id", "kind", "refers_to_record")
    asked = revisits.groupBy("refers_to_record").agg(F.count("*").alias("n"))
    targets = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).join(asked, "refers_to_record")
    found = spread_join(revisits, store.written(targets, "targets"), ["refers_to_record"], ["record_id"], "left").drop("record_id")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to")).unionByName(
        found.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written as an archive, deduplicated and read back: a row per page.

    Null payloads are empty ones. Null ids come back null and rank below all
    others. Rows that repeat an id and payload make records of their own: one
    response, else revisits of it. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = pages.sparkSession
    store.bounded_batches(spark)
    id_type = dict(pages.dtypes)["page_id"]
    raw, dedup = store.new_path(spark, "raw"), store.new_path(spark, "dedup")
    write_responses(pages, raw)
    write_deduplicated(spark, raw, dedup, id_type, min_bytes)
    return resolve(spark, dedup, id_type)


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
