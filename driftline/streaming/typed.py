"""Stateful streams with typed state: values, lists and maps that RocksDB holds
row by row, so that a batch writes what it changed and not a key's whole state.

They need the RocksDB state store (``rocksdb`` sets it for a block of code).
With ``ttl_s`` entries that weren't written for so long are forgotten, by the
clock of the machine; without it they stay until a session begins anew.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import asdict, fields

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import PhaseRules
from . import phase

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True)


class _Machine(StatefulProcessor):
    """The phase machine: its scalars are a value; the running windows are maps
    from a number of arrival to a sample, of which new ones are put in and old
    ones taken out; references that are being taken are lists."""

    WINDOWS, REFERENCES = ("values", "motion"), ("early", "after_onset")
    SCALARS = [f.name for f in fields(phase.Phase) if f.name not in ("values", "motion", "early", "after_onset")]
    KINDS = {"name": "string", "motion_missing": "boolean", "stopped": "boolean"}

    def __init__(self, rules: PhaseRules, ttl_s: float | None):
        self.rules, self.ttl = rules, None if ttl_s is None else int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        scalars = ", ".join(f"{name} {self.KINDS.get(name, 'double')}" for name in self.SCALARS)
        self.scalars = handle.getValueState("scalars", scalars, self.ttl)
        self.windows = {name: handle.getMapState(name, "n long", "t double, x double", self.ttl) for name in self.WINDOWS}
        self.references = {name: handle.getListState(name, "x double", self.ttl) for name in self.REFERENCES}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.scalars.get() if self.scalars.exists() else None
        p = phase.Phase(**dict(zip(self.SCALARS, known, strict=True))) if known else phase.Phase()
        held = {name: {k[0]: tuple(v) for k, v in sorted(state.iterator())} for name, state in self.windows.items()}
        taken = {name: [x[0] for x in state.get()] for name, state in self.references.items()}
        for name in self.WINDOWS:
            setattr(p, name, list(held[name].values()))
        for name in self.REFERENCES:
            setattr(p, name, list(taken[name]))
        found = phase.run(phase.in_order(_rows(rows)), p, self.rules)
        self.scalars.update(tuple(asdict(p)[name] for name in self.SCALARS))
        for name, state in self.windows.items():
            self._slide(state, held[name], getattr(p, name))
        for name, state in self.references.items():
            self._extend(state, taken[name], getattr(p, name))
        yield phase._frame(key[0], found)

    @staticmethod
    def _slide(state, before: dict[int, tuple], now: list[tuple]) -> None:
        """Samples keep their objects, which tell those held from new ones."""
        numbers = {id(sample): n for n, sample in before.items()}
        kept = {numbers[id(s)] for s in now if id(s) in numbers}
        for n in before.keys() - kept:
            state.removeKey((n,))
        new = [s for s in now if id(s) not in numbers]
        for n, sample in enumerate(new, max(before, default=-1) + 1):
            state.updateValue((n,), sample)

    @staticmethod
    def _extend(state, before: list[float], now: list[float]) -> None:
        if now[: len(before)] != before or (before and not now):
            state.clear()
            before = []
        if len(now) > len(before):
            state.appendList([(x,) for x in now[len(before) :]])

    def close(self) -> None:
        pass


def phase_stream(samples: DataFrame, rules: PhaseRules = PhaseRules(), ttl_s: float | None = None) -> DataFrame:
    """Decisions of ``phase.phase_stream``, with typed state. A finished
    session (fired or stopped) takes no samples in, so its state stays as it is
    until the next start. Rows with a null time are left out; samples with a
    null value change nothing."""
    kind = dict(samples.dtypes)["entity"]
    # a null key among numbers is NaN in pandas, which equals nothing, so keys are texts
    key = F.coalesce(F.concat(F.lit("="), F.col("entity").cast("string")), F.lit(""))
    keyed = samples.where("us IS NOT NULL").select(key.alias("_key"), "us", "kind", "value").groupBy("_key")
    out = keyed.transformWithStateInPandas(_Machine(rules, ttl_s), phase.DECISIONS.format(id="string"), "append", "none" if ttl_s is None else "processingTime")
    return out.withColumn("entity", F.when(F.col("entity") != "", F.substring("entity", 2, 1 << 30).cast(kind)))


class _Seen(StatefulProcessor):
    """Ids that the session has had, a map from each to nothing much."""

    def __init__(self, id_kind: str, ttl_s: float | None):
        self.id_kind, self.ttl = id_kind, None if ttl_s is None else int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"id {self.id_kind}", "us long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        anew, fresh = False, {}
        # of rows of one time, a start comes first
        for row in sorted(rows, key=lambda r: (r.us, r.kind != "start")):
            if row.kind == "start":
                anew, fresh = True, {}
            elif row.id not in fresh and (anew or not self.seen.containsKey((row.id,))):
                fresh[row.id] = row.us
                yield row
        if anew:
            self.seen.clear()
        for i, us in fresh.items():
            self.seen.updateValue((i,), (us,))

    def close(self) -> None:
        pass


def once_a_session(rows: DataFrame, ttl_s: float | None = None) -> DataFrame:
    """Of a stream (entity, us, kind, id, ...) the samples whose id their entity
    hasn't had since its last row of kind ``start``; starts themselves and rows
    with a null id or time are left out. Each batch is sorted by time, a start
    before the samples of its time; there is no reordering across batches. The
    state of an entity holds the ids of its running session alone."""
    keyed = rows.where("us IS NOT NULL AND (id IS NOT NULL OR kind = 'start')").groupBy("entity")
    return keyed.transformWithState(_Seen(dict(rows.dtypes)["id"], ttl_s), rows.schema, "append", "none" if ttl_s is None else "processingTime")
