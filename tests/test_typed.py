"""Streams with typed state over several batches, late rows and a restart, against plain loops."""

from __future__ import annotations

import random

import pandas as pd

from driftline import plans
from driftline.params import PhaseRules
from driftline.streaming import phase, typed

S = 1_000_000


def fed(spark, batches, schema, make, tmp_path):
    """What a stream gives when each batch is a file of its own; it is stopped
    and started anew from its checkpoint after half of them."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    half = len(batches) // 2
    for part in (batches[:half], batches[half:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        with typed.rocksdb(spark):
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
    assert query.exception() is None
    return [r.asDict() for r in spark.read.schema(stream.schema).parquet(out).collect()]


def held(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state"))


def night(entity, rng):
    """Forty minutes of samples that fall asleep and deepen; a few come late, some are null."""
    rows = [(entity, 0, "start", None)]
    for t in range(1, 2400, 5):
        level = 70 - 6 * (t > 300) - 8 * (t > 1000)
        rows.append((entity, t * S, "value", rng.choice([None, *[level + rng.random() * 0.5] * 20])))
        rows.append((entity, t * S, "motion", 0.001 + 0.001 * rng.random()))
    for _ in range(40):
        k = rng.randrange(1, len(rows) - 40)
        rows.insert(k + rng.randrange(40), rows.pop(k))
    return rows


def test_phases_over_batches_with_late_rows_and_a_restart(spark, tmp_path):
    rng, rules = random.Random(4), PhaseRules()
    entities = {1: night(1, rng), None: night(None, rng), 3: night(3, rng)}
    entities[3][400:400] = [(3, 1002 * S, "start", None)]  # a session begins anew in the middle
    entities[1].append((1, None, "value", 3.0))
    size = 200
    batches = [[r for rows in entities.values() for r in rows[k : k + size]] for k in range(0, 1000, size)]
    got = fed(spark, batches, "entity long, us long, kind string, value double", lambda df: typed.phase_stream(df, rules), tmp_path)

    want = []
    for entity, rows in entities.items():
        p = phase.Phase()
        for k in range(0, 1000, size):
            part = pd.DataFrame([r for r in rows[k : k + size] if r[1] is not None], columns=["entity", "us", "kind", "value"])
            if len(part):
                want += [{"entity": entity, **d} for d in phase.run(phase.in_order(part), p, rules)]
    key = lambda d: (d["entity"] or 0, d["us"], d["reason"])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {d["reason"] for d in got} >= {"onset_detected", "light_reference_captured", "deepening_pattern_sustained", "wake_fired"}
    # a window of 90 s and 120 s of lateness, a sample each 5 s, and those that lie behind late ones
    sizes = [r["count"] for name in ("values", "motion") for r in held(spark, tmp_path, name).groupBy("key").count().collect()]
    assert sizes and max(sizes) <= 2 * (90 + 120) / 5
    assert held(spark, tmp_path, "after_onset").count() == 0


def test_typed_and_batch_decide_alike(spark, sf_dir):
    found = plans.queries()
    assert sorted(map(tuple, found["phase_machine_typed"](spark, sf_dir).collect())) == sorted(map(tuple, found["phase_machine"](spark, sf_dir).collect()))


def test_ids_are_forgotten_at_a_start(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, None]), t * S, rng.choice(["value"] * 30 + ["start"]), rng.choice([None, "", *"abcdefgh"])) for t in range(600)]
    rows += [(1, 600 * S, "value", "a"), (1, 600 * S, "value", "a"), (1, 600 * S, "start", None), (1, None, "value", "new")]
    batches = [rows[k : k + 151] for k in range(0, len(rows), 151)]
    got = fed(spark, batches, "entity long, us long, kind string, id string", typed.once_a_session, tmp_path)

    want, seen = [], {}
    for part in batches:
        for entity, us, kind, i in sorted((r for r in part if r[1] is not None), key=lambda r: (r[1], r[2] != "start")):
            mine = seen.setdefault(entity, set())
            if kind == "start":
                mine.clear()
            elif i is not None and i not in mine:
                mine.add(i)
                want.append((entity, us, kind, i))
    assert sorted(map(str, (tuple(d.values()) for d in got))) == sorted(map(str, want))
    assert held(spark, tmp_path, "seen").count() == sum(map(len, seen.values()))


def test_the_store_is_put_back(spark):
    before = spark.conf.get(typed.PROVIDER)
    with typed.rocksdb(spark):
        assert spark.conf.get(typed.PROVIDER) == typed.ROCKSDB
    assert spark.conf.get(typed.PROVIDER) == before
