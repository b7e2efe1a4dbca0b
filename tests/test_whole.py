"""Queries that once read a part of their table read all of it."""

from __future__ import annotations

from driftline import plans


def test_every_duration_is_formatted(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert plans.queries()["fmt_duration"](spark, sf_dir).count() == rows


def test_every_entity_is_listed_and_scanned(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    entities = {r["user_id"] for r in ev.select("user_id").distinct().collect()}
    nights = {(str(r["user_id"]), r["event_type"]) for r in ev.where("value > 50").select("user_id", "event_type").distinct().collect()}
    found = plans.queries()
    assert {r["entity"] for r in found["scan_npz"](spark, sf_dir).collect()} == entities
    assert {tuple(r) for r in found["list_files"](spark, sf_dir).collect()} == nights
    assert found["scan_recovered_json"](spark, sf_dir).count() == ev.count()
