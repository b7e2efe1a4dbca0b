"""The document store and periodic snapshots."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from driftline import documents, sinks


def test_a_write_that_dies_leaves_the_old_document(tmp_path):
    system, folder = documents.opened(str(tmp_path))
    documents.replaced(system, folder, "a.json", b"old")

    class Dies:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def move(self, *_):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        documents.replaced(Dies(system), folder, "a.json", b"new and longer")
    assert (tmp_path / "a.json").read_bytes() == b"old" and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    documents.replaced(system, folder, "a.json", b"new")
    assert (tmp_path / "a.json").read_bytes() == b"new"


def test_store_changes_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("11111111-aaaa", 86_400.0, "x"), ("22222222-bbbb", 172_800.0, "é"), ("33333333-cccc", 0.0, None)]
    docs = spark.createDataFrame(rows, "sessionUUID string, startTimestamp double, rating string")
    assert documents.put(documents.named(docs).unionByName(documents.named(docs)), path) == 3
    assert {r["name"] for r in documents.names(spark, path).collect()} == {"1970-01-02_11111111.json", "1970-01-03_22222222.json", "1970-01-01_33333333.json"}
    legacy = {"sessionUUID": "44444444-dddd", "startTimestamp": 90_000.0, "kept": [1, 2]}
    (tmp_path / "store" / "44444444-dddd.json").write_text(json.dumps(legacy))
    (tmp_path / "store" / ".half.json.1").write_text("{")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").iterdir()}
    changes = [("11111111-aaaa", 1, "early", None), ("11111111-aaaa", 5, None, 7), ("11111111-aaaa", 3, "late", 6), ("44444444-dddd", 1, "old one", None), ("99999999", 1, "nobody", None), (None, 1, "null", None)]
    done = documents.changed(spark, path, spark.createDataFrame(changes, "id string, at int, rating string, n int"), "id", "at")
    assert sorted(map(tuple, done.collect())) == [("11111111-aaaa", "1970-01-02_11111111.json", True), ("44444444-dddd", "1970-01-02_44444444.json", True), ("99999999", None, False)]
    read = {r["name"]: json.loads(r["value"]) for r in documents.loaded(spark, path).collect()}
    assert read["1970-01-02_11111111.json"] == {"sessionUUID": "11111111-aaaa", "startTimestamp": 86_400.0, "rating": "late", "n": 7}
    assert read["1970-01-02_44444444.json"] == legacy | {"rating": "old one"} and read["44444444-dddd.json"] == legacy
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").iterdir()}
    assert {n for n in after if after[n] != before.get(n)} - {n for n in after if n.endswith(".crc")} == {"1970-01-02_11111111.json", "1970-01-02_44444444.json"}
    # found by its newer name from now on
    documents.changed(spark, path, spark.createDataFrame([("44444444-dddd", 1, "again")], "id string, at int, rating string"), "id", "at")
    assert json.loads((tmp_path / "store" / "1970-01-02_44444444.json").read_text())["rating"] == "again"


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.range(0, 30)
    df.where("id < 10").write.parquet(source)
    live = spark.readStream.schema(df.schema).parquet(source)
    running = sinks.checkpointed(live, out, state, "1 second")
    running.processAllAvailable()
    running.stop()
    # the commit of the batch is lost: the stream delivers it again
    for commit in (tmp_path / "state" / "commits").iterdir():
        if commit.name in ("0", ".0.crc"):
            commit.unlink()
    df.where("id BETWEEN 10 AND 19").write.mode("append").parquet(source)
    running = sinks.checkpointed(live, out, state, "1 second")
    running.processAllAvailable()
    running.stop()
    df.where("id >= 20").write.mode("append").parquet(source)  # comes after the last trigger
    found = sinks.finished(running, live, out, state)
    assert found.count() == 30 and found.agg(F.sum("id")).first()[0] == sum(range(30))


def test_lines_go_to_a_file_for_each_name(spark, tmp_path):
    """Also where a name's lines come in many batches, and nothing else is left in the folders."""
    path = str(tmp_path / "lines")
    rows = spark.range(25_000).select(F.concat(F.col("id") % 3, F.lit("/"), F.col("id") % 2, F.lit(".csv")).alias("name"), F.when(F.col("id") > 5, F.col("id").cast("string")).alias("line"))
    assert documents.write_lines(rows, path) == 6
    files = {str(f.relative_to(path)): sorted(f.read_text().split("\n")[:-1]) for f in (tmp_path / "lines").rglob("*") if f.is_file()}
    assert files == {f"{k}/{m}.csv": sorted(str(i) if i > 5 else "" for i in range(25_000) if i % 3 == k and i % 2 == m) for k in range(3) for m in range(2)}


def test_folders_are_walked_once_each(spark, tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "files")
    names = ["top.txt", *(f"{k % 70}/{k}/x.txt" for k in range(150))]
    assert documents.write(spark.createDataFrame([(n, n) for n in names], "name string, content string"), path) == 151
    (tmp_path / "files" / "_hidden").mkdir()
    (tmp_path / "files" / "_hidden" / "y.txt").write_text("y")
    found = documents.walked(spark, path, lambda system, folder, names: [(f"{folder}/{n}",) for n in names], [("path", pa.string())], "path string")
    assert sorted(r["path"] for r in found.collect()) == sorted(f"{path}/{n}" for n in names)
