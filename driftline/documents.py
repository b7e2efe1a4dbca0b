"""A store of JSON documents, one committed file each, and folders of many
small files.

Executors write a document to a hidden name next to its own and rename it, so
a reader, or a task that died half-way, finds the old document or the new one,
never a part. A change loads, alters and rewrites only the documents that it
touches. Paths are local ones or URIs that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialized
from .sinks import document_name


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def replaced(system: fs.FileSystem, folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all."""
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(hidden) as out:
            out.write(data)
        system.move(hidden, f"{folder}/{name}")
    except BaseException:
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_file(hidden)
        raise


def write(files: DataFrame, path: str) -> int:
    """Writes (name, content), one committed file each, and says how many. A
    name may begin with folders; each must come once."""
    system, top = opened(path)
    system.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(path)
        made = None
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder, _, last = f"{top}/{name}".rpartition("/")
                if folder != made:
                    system.create_dir(folder, recursive=True)
                    made = folder
                replaced(system, folder, last, content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string").count()


def write_lines(rows: DataFrame, path: str) -> int:
    """Writes (name, line), a committed file for each name, and says how many.
    A task has one file open, to which lines go as they come."""
    system, top = opened(path)
    system.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(path)
        now = hidden = out = None
        done: list[str] = []

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                system.move(hidden, f"{top}/{now}")
                done.append(now)

        try:
            for batch in batches:
                runs = pc.run_end_encode(batch.column("name"))
                ends = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends.cast(pa.int32())])
                texts = pc.binary_join(pa.ListArray.from_arrays(ends, batch.column("line").cast(pa.string())), "\n")
                for name, text in zip(runs.values.to_pylist(), texts.to_pylist(), strict=True):
                    if name != now:
                        finish()
                        folder, _, last = name.rpartition("/")
                        system.create_dir(f"{top}/{folder}", recursive=True)
                        now, hidden = name, f"{top}/{folder}/.{last}.{uuid.uuid4().hex}"
                        out = system.open_output_stream(hidden)
                    out.write(f"{text}\n".encode())
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])
                done.clear()
            finish()
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(hidden)
            raise
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    dealt = rows.select("name", F.coalesce("line", F.lit("")).alias("line")).repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, "name string").count()


#: Folders that are enough to deal them out.
FEW = 64
#: What a task that walks through folders hands on at once: rows, and characters.
ROWS, CHARACTERS = 2_000, 8 << 20


def shown(found: fs.FileInfo) -> bool:
    return not found.base_name.startswith((".", "_"))


def walked(spark: SparkSession, path: str, visit: Callable[[fs.FileSystem, str, list[str]], Iterable[tuple]], columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """What ``visit(system, folder, names)`` gives for each folder below ``path``
    with the names of its files; hidden ones are left out. Upper levels are
    listed here, until there are a few folders, and what is below by tasks."""
    system, top = opened(path)
    upper: list[str] = []
    folders = [top]
    while folders and len(folders) < FEW:
        upper += folders
        folders = [i.path for f in folders for i in system.get_file_info(fs.FileSelector(f)) if shown(i) and not i.is_file]
    starts = [(f, False) for f in upper] + [(f, True) for f in folders]

    def below(system: fs.FileSystem, folder: str, deep: bool) -> Iterator[tuple]:
        left = [folder]
        while left:
            at = left.pop()
            found = [i for i in system.get_file_info(fs.FileSelector(at)) if shown(i)]
            yield from visit(system, at, sorted(i.base_name for i in found if i.is_file))
            if deep:
                left += [i.path for i in found if not i.is_file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(path)
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in below(system, folder, deep):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
                    if len(rows) >= ROWS or size >= CHARACTERS:
                        yield of(rows)
                        rows, size = [], 0
        if rows:
            yield of(rows)

    return spark.createDataFrame(starts, "folder string, deep boolean").mapInArrow(run, schema)


def put(docs: DataFrame, path: str) -> int:
    """Writes (name, value), one file each, and says how many. Of documents of
    one name the greatest value stays; null names and values are left out."""
    system, folder = opened(path)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                replaced(system, folder, name, value.encode())
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    one = docs.where("name IS NOT NULL AND value IS NOT NULL").groupBy("name").agg(F.max("value").alias("value"))
    return one.mapInArrow(write, "name string").count()


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the documents; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1).alias("name"))


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of all documents."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")


def encoded(fields: dict) -> bytes:
    return json.dumps(fields, sort_keys=True, indent=2, ensure_ascii=False).encode()


def changed(spark: SparkSession, path: str, changes: DataFrame, key: str, at: str, start: str = "startTimestamp") -> DataFrame:
    """Sets fields of documents: ``changes`` has ``key``, the time ``at`` and
    columns named like fields; the latest value of each that isn't null counts.
    A document is found by the first eight characters of its key at the end of
    its name, or else by the older name, the whole key; it is written under
    the former. Gives (key, name, found); keys without a document change
    nothing. One task touches a document."""
    fields = [c for c in changes.columns if c not in (key, at)]
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in fields])
    wanted = last.select("key", F.to_json(F.struct(*fields)).alias("change"))
    listed = names(spark, path)
    newer = listed.select(F.regexp_extract("name", r"_(.{1,8})\.json$", 1).alias("short"), F.col("name").alias("newer")).where("short <> ''").groupBy("short").agg(F.min("newer").alias("newer"))
    older = listed.select(F.regexp_replace("name", r"\.json$", "").alias("key"), F.col("name").alias("older"))
    found = wanted.withColumn("short", F.left("key", F.lit(8))).join(newer, "short", "left").join(older, "key", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["name"] is not None:
                    with system.open_input_file(f"{folder}/{row['name']}") as file:
                        document = json.loads(file.read())
                    document.update(json.loads(row["change"]))
                    # a document that has an older name moves on to the newer one
                    target = row["name"] if row["newer"] is not None else row["target"].replace("{day}", _day(document.get(start)))
                    replaced(system, folder, target, encoded(document))
                    row["name"] = target
                out.append((row["key"], row["name"], row["name"] is not None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.string(), pa.bool_()), strict=True)], ["key", "name", "found"])

    rows = found.select("key", "change", "newer", F.coalesce("newer", "older").alias("name"), F.concat(F.lit("{day}_"), F.left("key", F.lit(8)), F.lit(".json")).alias("target"))
    return materialized(rows.mapInArrow(rewrite, "key string, name string, found boolean"), "changed")


def _day(seconds: float | None) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds or 0, UTC).strftime("%Y-%m-%d")


def named(docs: DataFrame, key: str = "sessionUUID", start: str = "startTimestamp") -> DataFrame:
    """(name, value) of documents whose columns are their fields."""
    return docs.select(document_name(F.col(start), F.col(key).cast("string")).alias("name"), F.to_json(F.struct(*sorted(docs.columns)), {"pretty": "true"}).alias("value"))
