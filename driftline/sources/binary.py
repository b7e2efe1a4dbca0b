"""Binary recordings: EDF headers and MATLAB 5 matrices, from their published
layouts. A MATLAB file holds a night's labels, a few kilobytes; it is one row of
Spark's binary reader. ``edf`` reads signals."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of each field of the EDF signal headers, in order.
EDF_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))
#: Data types of MATLAB elements.
MAT_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8", 16: "u1", 17: "<u2"}
MAT_COMPRESSED, MAT_MATRIX, MAT_CHAR_CLASS = 15, 14, 4


def edf_header(data: bytes) -> dict:
    """patient, start (dd.mm.yy hh.mm.ss), records, record_s, header_bytes and signals."""
    text = lambda a, b: data[a:b].decode("latin-1").strip()
    n = int(text(252, 256))
    at, signals = 256, [{} for _ in range(n)]
    for name, width in EDF_FIELDS:
        for k in range(n):
            signals[k][name] = text(at, at + width)
            at += width
    header, record_s = int(text(184, 192)), float(text(244, 252))
    records = int(text(236, 244))
    if records < 0:  # not known when the recording began
        records = (len(data) - header) // (2 * sum(int(s["samples"]) for s in signals))
    return {"patient": text(8, 88), "start": f"{text(168, 176)} {text(176, 184)}", "records": records, "record_s": record_s, "header_bytes": header, "signals": signals}


def _element(data: bytes, at: int) -> tuple[int, bytes, int]:
    """(type, bytes, next place) of a MATLAB element; short ones have four
    bytes within their tag."""
    kind, size = struct.unpack_from("<II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, data[at + 8 : end], end if kind == MAT_COMPRESSED else at + 8 + (size + 7) // 8 * 8


def mat_arrays(data: bytes) -> dict[str, np.ndarray | str]:
    """The numeric and character matrices of a MATLAB 5 file."""
    out: dict[str, np.ndarray | str] = {}
    at = 128
    while at + 8 <= len(data):
        kind, body, at = _element(data, at)
        if kind == MAT_COMPRESSED:
            kind, body, _ = _element(zlib.decompress(body), 0)
        if kind != MAT_MATRIX:
            continue
        _, flags, p = _element(body, 0)
        _, dims, p = _element(body, p)
        _, name, p = _element(body, p)
        if p >= len(body):
            continue
        value_kind, raw, _ = _element(body, p)
        if value_kind not in MAT_TYPES:
            continue  # cells and structs
        values = np.frombuffer(raw, MAT_TYPES[value_kind])
        if flags[0] == MAT_CHAR_CLASS:
            out[name.decode()] = "".join(map(chr, values))
        else:
            out[name.decode()] = values.reshape(np.frombuffer(dims, "<i4"), order="F")
    return out


def mat_labels(spark: SparkSession, path: str, labels: str = "expert_label", start: str = "recStart") -> DataFrame:
    """(file, start, k, stage): one row per label epoch."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                found = mat_arrays(data)
                if labels in found:
                    stages = np.asarray(found[labels]).ravel().astype(int)
                    yield pd.DataFrame({"file": file, "start": found.get(start), "k": np.arange(len(stages)), "stage": stages})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "file string, start string, k long, stage int")
