"""EDF recordings by ranges: a data source whose partitions are runs of data
records, read by seek.

``spark.read.format("edf").load(path)`` gives (file, signal, label, unit, rate,
start, record_s, record, samples): the physical values of each data record of
each signal. A recording of any size is dealt over as many tasks as it has
ranges of ``rangeBytes``; of a file, only its header and the ranges are read.
``labels`` (separated by ``|``) and filters on ``label`` leave out signals.

Files are opened through Arrow's file systems, so a path is a local one or a
URI that Arrow knows (file, s3, gs, hdfs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..documents import opened
from .binary import EDF_FIELDS, edf_header

FIXED = 256
SCHEMA = "file string, signal int, label string, unit string, rate double, start string, record_s double, record long, samples array<float>"
ARROW = pa.schema([
    ("file", pa.string()), ("signal", pa.int32()), ("label", pa.string()), ("unit", pa.string()), ("rate", pa.float64()), ("start", pa.string()),
    ("record_s", pa.float64()), ("record", pa.int64()), ("samples", pa.list_(pa.float32())),
])
#: Bytes that a task holds at once.
SLICE = 8 << 20


@dataclass
class Range:
    """Records ``first`` to before ``last`` of a file; all if ``last`` is None.
    Files without a whole header have no range."""

    file: str
    size: int
    first: int
    last: int | None


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a large file, or several small files."""

    ranges: list[Range]


def header_of(file, size: int) -> dict:
    """The header's fields, from its own bytes alone."""
    head = file.read(FIXED)
    head += file.read(int(head[252:256]) * sum(width for _, width in EDF_FIELDS))
    found = edf_header(head) if int(head[236:244]) >= 0 else None
    if found is None:  # the number of records wasn't known when the recording began
        found = edf_header(head[:236] + b"0       " + head[244:])
        found["records"] = (size - found["header_bytes"]) // record_bytes(found)
    return found


def record_bytes(head: dict) -> int:
    return 2 * sum(int(s["samples"]) for s in head["signals"])


class EdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 64 << 20))
        named = options.get("labels")
        self.labels = set(named.split("|")) if named else None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("label",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.labels = wanted if self.labels is None else self.labels & wanted
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.size > FIXED and not f.base_name.startswith(("_", "."))]
        out: list[Ranges] = []
        small: list[Range] = []
        packed = 0
        # at least so many tasks as there are files, or sixty-four
        pack = min(self.range_bytes, sum(f.size for f in files) // 64)
        for f in sorted(files, key=lambda f: f.path):
            if f.size <= self.range_bytes:  # one range: its task reads the header
                small.append(Range(f.path, f.size, 0, None))
                packed += f.size
                if packed >= pack:
                    out.append(Ranges(small))
                    small, packed = [], 0
                continue
            with system.open_input_file(f.path) as file:
                head = header_of(file, f.size)
            step = max(1, self.range_bytes // record_bytes(head))
            out += [Ranges([Range(f.path, f.size, a, min(a + step, head["records"]))]) for a in range(0, head["records"], step)]
        return out + ([Ranges(small)] if small else [])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for one in partition.ranges:
            yield from self.records(system, one)

    def records(self, system: fs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(partition.file) as file:
            head = header_of(file, partition.size)
            signals = head["signals"]
            sizes = [int(s["samples"]) for s in signals]
            at = np.concatenate([[0], np.cumsum(sizes)])
            kept = [k for k, s in enumerate(signals) if self.labels is None or s["label"] in self.labels]
            whole = record_bytes(head)
            # a file that was cut off ends with its last whole record
            last = min(head["records"] if partition.last is None else partition.last, (partition.size - head["header_bytes"]) // whole)
            step = max(1, SLICE // whole)
            for first in range(partition.first, last, step):
                n = min(step, last - first)
                file.seek(head["header_bytes"] + first * whole)
                raw = np.frombuffer(file.read(n * whole), "<i2").reshape(n, -1)
                for k in kept:
                    s = signals[k]
                    d0, d1, p0, p1 = (float(s[f]) for f in ("digital_min", "digital_max", "physical_min", "physical_max"))
                    values = ((raw[:, at[k] : at[k + 1]] - d0) * ((p1 - p0) / (d1 - d0)) + p0).astype(np.float32)
                    samples = pa.ListArray.from_arrays(pa.array(np.arange(0, n * sizes[k] + 1, max(1, sizes[k]), dtype=np.int32)[: n + 1] if sizes[k] else np.zeros(n + 1, np.int32)), pa.array(values.ravel()))
                    same = lambda v: pa.array([v] * n)  # noqa: E731, B023
                    columns = [same(partition.file), pa.array([k] * n, pa.int32()), same(s["label"]), same(s["unit"]), same(sizes[k] / head["record_s"]), same(head["start"]), same(head["record_s"]), pa.array(np.arange(first, first + n)), samples]
                    yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)


HEADERS = pa.schema([("file", pa.string()), ("patient", pa.string()), ("start", pa.string()), ("records", pa.int64()), ("record_s", pa.float64()), ("n_signals", pa.int32()), ("labels", pa.string()), ("hours", pa.float64())])


class EdfHeaderReader(EdfReader):
    def pushFilters(self, filters):  # noqa: N802
        return filters

    def records(self, system: fs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first:
            return  # the first range of a file tells all
        with system.open_input_file(partition.file) as file:
            h = header_of(file, partition.size)
        row = (partition.file, h["patient"], h["start"], h["records"], h["record_s"], len(h["signals"]), "|".join(s["label"] for s in h["signals"]), h["records"] * h["record_s"] / 3600)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, HEADERS.types, strict=True)], schema=HEADERS)


class EdfHeaderSource(EdfSource):
    @classmethod
    def name(cls) -> str:
        return "edf_header"

    def schema(self) -> str:
        return "file string, patient string, start string, records long, record_s double, n_signals int, labels string, hours double"

    def reader(self, schema) -> EdfHeaderReader:
        return EdfHeaderReader(self.options)


def _registered(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a source and lets Spark hand filters to it, which it does only
    where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def edf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, patient, start, records, record_s, n_signals, labels, hours), from the
    headers alone."""
    _registered(spark, EdfHeaderSource)
    return spark.read.format("edf_header").load(path)


def edf(spark: SparkSession, path: str, labels: list[str] | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """The records of all recordings below ``path``."""
    _registered(spark, EdfSource)
    reader = spark.read.format("edf").option("rangeBytes", range_bytes)
    return (reader.option("labels", "|".join(labels)) if labels else reader).load(path)
