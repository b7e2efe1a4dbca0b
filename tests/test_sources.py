"""Binary formats from bytes made here, and the phase machine in batch and stream."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from driftline.sources import edf as edf_source
from driftline.sources import binary, text
from driftline.streaming import phase


def element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def matrix(name: str, values: np.ndarray | str) -> bytes:
    chars = isinstance(values, str)
    raw = values.encode("utf-16-le") if chars else values.astype("u1").tobytes()
    dims = struct.pack("<ii", 1, len(values))
    return element(14, element(6, struct.pack("<II", 4 if chars else 9, 0)) + element(5, dims) + element(1, name.encode()) + element(17 if chars else 2, raw))


def test_mat_labels(spark, tmp_path):
    stages = np.array([0, 1, 2, 3, 3, 5])
    packed = zlib.compress(matrix("expert_label", stages))
    data = b" " * 128 + matrix("recStart", "2020-01-01 22:00:00") + struct.pack("<II", 15, len(packed)) + packed
    (tmp_path / "a.mat").write_bytes(data)
    rows = binary.mat_labels(spark, str(tmp_path)).orderBy("k").collect()
    assert [r["stage"] for r in rows] == stages.tolist() and rows[0]["start"] == "2020-01-01 22:00:00"


def edf(samples: np.ndarray, records: int = -1) -> bytes:
    pad = lambda s, n: str(s).ljust(n).encode()
    head = pad("0", 8) + pad("p", 80) + pad("r", 80) + pad("01.02.20", 8) + pad("22.30.00", 8) + pad(512, 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(1, 4)
    signal = [("ECG", 16), ("", 80), ("mV", 8), (-1, 8), (1, 8), (-100, 8), (100, 8), ("", 80), (4, 8), ("", 32)]
    return head + b"".join(pad(*x) for x in signal) + samples.astype("<i2").tobytes()


def test_edf(spark, tmp_path):
    (tmp_path / "n1.edf").write_bytes(edf(np.array([-100, 0, 50, 100, 0, 0, 0, -50])))
    rows = edf_source.edf(spark, str(tmp_path), ["ECG"]).orderBy("record").collect()
    assert np.allclose(rows[0]["samples"], [-1, 0, 0.5, 1]) and np.allclose(rows[1]["samples"], [0, 0, 0, -0.5]) and rows[0]["rate"] == 4
    head = edf_source.edf_headers(spark, str(tmp_path)).first()
    assert (head["records"], head["labels"], head["start"]) == (2, "ECG", "01.02.20 22.30.00")


def test_edf_in_ranges(spark, tmp_path):
    """One recording over many tasks, with and without its number of records,
    cut off within a record, and filters on labels."""
    x = np.arange(-3_000, 3_000)
    for name, records in (("known", 1500), ("unknown", -1)):
        (tmp_path / f"{name}.edf").write_bytes(edf(x, records) + b"\1\2\3")
    whole = edf_source.edf(spark, str(tmp_path))
    parts = edf_source.edf(spark, str(tmp_path), range_bytes=800)
    assert whole.rdd.getNumPartitions() == 2 and parts.rdd.getNumPartitions() == 30
    read = lambda df: sorted((r["file"], r["record"], tuple(r["samples"])) for r in df.collect())
    assert read(whole) == read(parts) and len(read(parts)) == 3_000
    assert np.allclose(np.concatenate([s for f, _, s in read(parts) if "unknown" in f]), x / 100)
    assert parts.where("label = 'EEG'").count() == 0 and edf_source.edf(spark, str(tmp_path), ["EEG"]).count() == 0
    assert parts.where("label = 'ECG' AND record = 7").count() == 2
    (tmp_path / "short.edf").write_bytes(edf(x[:6], 5))
    assert edf_source.edf(spark, f"file://{tmp_path}/short.edf").count() == 1  # the second record isn't whole


def test_hypnogram_rolls_over_midnight(spark, tmp_path):
    lines = ["Name\tX", "", "Sleep Stage\tPosition\tTime [hh:mm:ss]\tEvent\tDuration[s]", "S2\tÄ\t23:59:30\tSLEEP-S2\t30", "-\t-\t23:59:40\tMCAP-A1\t5", "S3\t-\t00.00.00\tSLEEP-S3\t30", "S3\t-\t00.01.00\tSLEEP-S9\t30"]
    (tmp_path / "h.txt").write_bytes("\n".join(lines).encode("latin-1"))
    timed = text.clock_times(text.hypnogram(spark, str(tmp_path), {"SLEEP-S2": 2, "SLEEP-S3": 3}))
    assert [(r["t"], r["stage"]) for r in timed.orderBy("line").collect()] == [(86370, 2), (86400, 3), (86460, 5)]
    from pyspark.sql import functions as F

    dense = text.dense_epochs(timed, 30, F.lit(86490.0))
    assert [(r["k"], r["stage"]) for r in dense.orderBy("k").collect()] == [(0, 2), (1, 3), (2, 5), (3, 5)]


def test_csv_series_and_pairs(spark, tmp_path):
    for night in ("2", "10"):
        folder = tmp_path / "s1" / night
        folder.mkdir(parents=True)
        (folder / "hr.csv").write_text("1.0,60\n\nbad,1\n2.0\n3.5,62\n")
        (folder / "labels.mat").write_text("x")
    rows = text.csv_series(spark, f"{tmp_path}/*/*/hr.csv").where("night = '2'").orderBy("t").collect()
    assert [(r["entity"], r["t"], r["value"]) for r in rows] == [("s1", 1.0, 60.0), ("s1", 3.5, 62.0)]
    assert [r["night"] for r in text.paired_files(spark, str(tmp_path), "hr.csv", "labels.mat").collect()] == ["2", "10"]


def night(deep: bool = True):
    rows = [(t, "value", 70.0) for t in range(0, 185, 5)]
    rows += [(t, "motion", 0.001) for t in range(0, 1200, 5)]
    rows += [(t, "value", 64.0) for t in range(185, 500, 5)]
    rows += [(t, "value", 55.0 if deep else 64.0) for t in range(500, 1000, 5)]
    return [(7, t * 1_000_000, k, v) for t, k, v in rows]


def test_phase_machine_fires_and_matches_the_stream(spark, tmp_path):
    rows = spark.createDataFrame(night(), "entity long, us long, kind string, value double")
    found = phase.phase_decisions(rows).orderBy("us").collect()
    assert [r["phase_to"] for r in found] == ["asleep", "asleep", "confirming", "wake_fired"]
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = phase.phase_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    again = spark.read.parquet(str(tmp_path / "out")).orderBy("us").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in found]


def test_phase_machine_failed_confirmation():
    p, out = phase.Phase(), []
    from driftline.params import PhaseRules

    rules = PhaseRules(confirm_s=10_000)
    shallow = [(7, t * 1_000_000, "value", 64.0) for t in range(1000, 1100, 5)]
    for _, us, kind, x in sorted(night() + shallow, key=lambda r: (r[1], r[2])):
        out += phase.step(p, us / 1e6, kind, x, rules)
    assert [d["reason"] for d in out][-1] == "confirmation_failed" and p.light is not None and p.hold_since is None


def test_phase_machine_without_motion():
    from driftline.params import PhaseRules

    p, out = phase.Phase(), []
    for _, us, kind, x in (r for r in night() if r[2] == "value"):
        out += phase.step(p, us / 1e6, kind, x, PhaseRules())
    assert [d["reason"] for d in out] == ["phase1_motion_unavailable"]


def test_stream_is_written_every_so_often(spark, tmp_path):
    """The sink flushes at each trigger, and a second run goes on where the first stopped."""
    from driftline import sinks

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in (range(0, 5), range(5, 9)):
        spark.createDataFrame([(i,) for i in batch], "id long").write.mode("append").parquet(source)
        stream = sinks.checkpointed(spark.readStream.schema("id long").parquet(source), out, state, every="1 second")
        try:
            stream.processAllAvailable()
            assert stream.lastProgress is not None
        finally:
            stream.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(9))


def test_recordings_hold_values_beyond_sixteen_bits(spark):
    """Values above 500, negative ones, ones of more than 16 bits of tenths, and nulls, as floor(value * 10) says."""
    from driftline.plans import recordings

    values = {1: [560.21, 0.07, 3.99], 2: [-12.34, 499.9], 3: [1e9 + 0.1, -3e5, None, 7.0]}
    ev = spark.createDataFrame([(e, k, x) for e, xs in values.items() for k, x in enumerate(xs)], "entity long, us long, value double")
    found = {r["label"]: (r["n"], r["total"]) for r in recordings.scan_edf_signal(ev).collect()}
    tenths = {e: sum(math.floor(x * 10) for x in xs if x is not None) for e, xs in values.items()}
    assert found == {f"E{e}": (len(xs) + len(xs) % 2, round(tenths[e] / 10, 1)) for e, xs in values.items()}
    assert {(r["labels"], r["records"]) for r in recordings.scan_edf_header(ev).collect()} == {("E1", 2), ("E2", 1), ("E3", 2)}


def test_listed_files_have_any_name(spark):
    """Names that a path can't hold as they are, absent names, and nights without a value above 50."""
    from driftline.plans import recordings

    rows = [(1, "a=b", 60.0), (1, "a=b", 70.0), (1, "x/y z+%", 51.0), (2, None, 99.0), (None, "view", 80.0), (3, "low", 50.0), (4, "none", None), (5, "..", math.nan)]
    ev = spark.createDataFrame(rows, "entity long, event_type string, value double")
    found = sorted(((r["entity"], r["night"]) for r in recordings.list_files_all(ev).collect()), key=repr)
    assert found == sorted([("1", "a=b"), ("1", "x/y z+%"), ("2", None), (None, "view"), ("5", "..")], key=repr)
    assert recordings.list_files_all(ev.where("false")).count() == 0


def test_recovered_samples_of_equal_times_are_joined_one_to_one(spark, tmp_path):
    from driftline.plans import recordings

    rows = [(1, 1.0, 60.0, "view"), (1, 1.0, 61.0, "click"), (1, 2.0, None, "view"), (2, 1.0, math.nan, None), (3, 1e9 + 0.123456, 7.5, "é \"x\"\n")]
    ev = spark.createDataFrame(rows, "entity long, t double, value double, event_type string")
    found = recordings.scan_recovered_json_all(ev).collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr((t, x, s)) for _, t, x, s in rows)
    assert recordings.scan_recovered_json_all(ev.where("false")).count() == 0
    (tmp_path / "a.hr.json").write_text('[{"t": 1, "bpm": 50}, {"t": 2, "bpm": 51}]')
    (tmp_path / "a.stages.json").write_text('[{"t": 2, "stage": "deep"}, {"t": 3, "stage": "light"}]')
    (tmp_path / "b.hr.json").write_text('[{"t": 2, "bpm": 52}]')
    assert [tuple(r) for r in text.recovered(spark, str(tmp_path)).collect()] == [(2.0, 51.0, "deep")]
