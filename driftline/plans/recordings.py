"""Binary recordings, files and live sources: each is made from the event
stream in the shared folder, and read back."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import documents, sinks
from ..functions import scalar
from ..operators import ecg, frames, series
from ..shared import materialized, new_path
from ..sources import binary, edf, text
from ..streaming import phase
from .formats import _as_stream, _drained
from .registry import DAY, EV, US, V, query, r

CODES = "CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 0 ELSE 1 END"


def _files(rows: DataFrame, make: Callable[[pd.DataFrame], bytes], path: str) -> None:
    """Writes what ``make`` gives for each entity's rows as a file named like it."""
    system, folder = documents.opened(path)
    system.create_dir(folder, recursive=True)

    def write(own: pd.DataFrame) -> pd.DataFrame:
        system, folder = documents.opened(path)
        name = str(own["entity"].iloc[0])
        documents.replaced(system, folder, name, make(own))
        return pd.DataFrame({"name": [name]})

    rows.groupBy("entity").applyInPandas(write, "name string").count()


def _mat(name: str, kind: int, body: bytes, dims: tuple[int, int], value_type: int) -> bytes:
    def element(t: int, data: bytes) -> bytes:
        return struct.pack("<II", t, len(data)) + data + b"\0" * (-len(data) % 8)

    return element(14, element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<ii", *dims)) + element(1, name.encode()) + element(value_type, body))


@query("scan_labels_mat", f"{EV} SELECT entity::VARCHAR AS start, row_number() OVER (PARTITION BY entity ORDER BY us) - 1 AS k, {CODES} AS stage FROM ev")
def scan_labels_mat(ev: DataFrame) -> DataFrame:
    code = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "view", 0).otherwise(1)
    path = new_path(ev.sparkSession, "labels")

    def make(rows: pd.DataFrame) -> bytes:
        stages = rows.sort_values("us")["code"].to_numpy("u1").tobytes()
        start = str(rows["entity"].iloc[0])
        return b" " * 128 + _mat("recStart", 4, start.encode("utf-16-le"), (1, len(start)), 17) + _mat("expert_label", 9, stages, (1, len(stages)), 2)

    _files(ev.select("entity", "us", code.alias("code")), make, path)
    return binary.mat_labels(ev.sparkSession, path).select("start", "k", "stage")


def _words(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as signed 16-bit digits to the base 65,536, the lowest first."""
    out, rest = [], x.astype(np.int64)
    while not out or rest.any():
        out.append(((rest + 32_768) & 0xFFFF) - 32_768)
        rest = (rest - out[-1]) >> 16
    return out


def _edf_files(ev: DataFrame) -> str:
    """One recording per entity: its values, in tenths, as two samples a record;
    nulls are zero. Values that 16 bits don't hold have further signals for
    their higher digits. The format knows no infinity and no NaN."""
    path = new_path(ev.sparkSession, "edf")

    def make(rows: pd.DataFrame) -> bytes:
        x = np.floor(rows.sort_values("us")["value"].to_numpy() * 10)
        if not np.isfinite(x).all():
            raise ValueError(f"a value of {rows['entity'].iloc[0]} isn't finite")
        words = _words(np.concatenate([x, np.zeros(len(x) % 2)]))
        n = len(words)
        pad = lambda s, n: str(s).ljust(n).encode()
        head = pad(0, 8) + pad(rows["entity"].iloc[0], 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 + 256 * n, 8) + pad("", 44) + pad(len(words[0]) // 2, 8) + pad(1, 8) + pad(n, 4)
        fields = [(f"E{rows['entity'].iloc[0]}", 16), ("", 80), ("bpm/10", 8), (-32_768, 8), (32_767, 8), (-32_768, 8), (32_767, 8), ("", 80), (2, 8), ("", 32)]
        return head + b"".join(pad(*f) * n for f in fields) + np.hstack([w.reshape(-1, 2) for w in words]).astype("<i2").tobytes()

    _files(ev.select("entity", "us", F.coalesce(V(), F.lit(0.0)).alias("value")), make, path)
    return path


@query("scan_edf_header", f"{EV} SELECT 'E' || entity AS labels, ceil(count(*) / 2)::BIGINT AS records FROM ev GROUP BY entity")
def scan_edf_header(ev: DataFrame) -> DataFrame:
    return edf.edf_headers(ev.sparkSession, _edf_files(ev)).select(F.split("labels", r"\|")[0].alias("labels"), "records")


@query("scan_edf_signal", f"{EV} SELECT 'E' || entity AS label, count(*) + count(*) % 2 AS n, round(sum(floor(value * 10)) / 10, 1) AS total FROM ev GROUP BY entity")
def scan_edf_signal(ev: DataFrame) -> DataFrame:
    """Sums of tenths are whole numbers, so they are exact in any order."""
    rows = edf.edf(ev.sparkSession, _edf_files(ev))
    tenths = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) * F.pow(F.lit(65_536.0), F.col("signal"))
    return rows.groupBy("label").agg(F.sum(F.when(F.col("signal") == 0, F.size("samples")).otherwise(0)).alias("n"), r(F.sum(tenths) / 10, 1).alias("total"))


ECG_RATE = 128


def _ecg_files(ev: DataFrame) -> str:
    """One recording an entity: each of its values is the time to the next beat,
    600 ms and 6 for each unit, within 1.4 s, in two leads with drift, waves and noise."""
    path = new_path(ev.sparkSession, "ecg")

    def make(rows: pd.DataFrame) -> bytes:
        entity = int(rows["entity"].iloc[0])
        rr = np.clip(600 + 6 * rows.sort_values("us")["value"].fillna(0).to_numpy(), 600, 1400) / 1000
        beat = 0.5 + np.concatenate([[0.0], np.cumsum(rr)])
        seconds = int(np.ceil(beat[-1] + 1))
        t = np.arange(seconds * ECG_RATE) / ECG_RATE
        since = t - beat[np.clip(np.searchsorted(beat, t + 0.3) - 1, 0, len(beat) - 1)]
        wave = np.exp(-((since / 0.012) ** 2)) - 0.2 * np.exp(-(((since - 0.035) / 0.012) ** 2)) + 0.25 * np.exp(-(((since - 0.25) / 0.05) ** 2))
        x = wave + 0.3 * np.sin(2 * np.pi * 0.3 * t) + 0.02 * np.random.default_rng(entity).normal(size=len(t))
        ours, theirs = (np.clip(np.round(v * 1000), -5000, 5000).astype("<i2").reshape(seconds, ECG_RATE) for v in (0.7 * x, -0.3 * x))
        pad = lambda s, n: str(s).ljust(n).encode()
        head = pad(0, 8) + pad(entity, 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(768, 8) + pad("", 44) + pad(seconds, 8) + pad(1, 8) + pad(2, 4)
        fields = [(("ECG1", "ECG2"), 16), (("", ""), 80), (("mV", "mV"), 8), ((-5, -5), 8), ((5, 5), 8), ((-5000, -5000), 8), ((5000, 5000), 8), (("", ""), 80), ((ECG_RATE, ECG_RATE), 8), (("", ""), 32)]
        return head + b"".join(pad(v, n) for pair, n in fields for v in pair) + np.hstack([ours, theirs]).astype("<i2").tobytes()

    _files(ev.select("entity", "us", "value"), make, path)
    return path


@query("ecg_ingest")
def ecg_ingest(ev: DataFrame) -> DataFrame:
    """From recordings to a row each: leads, beats, judged intervals, rates in
    bins of five seconds, and label epochs of ten seconds, in which a value
    above 40 is deep; half an epoch lies before the recording and some after it."""
    spark = ev.sparkSession
    path = _ecg_files(ev)
    named = edf.edf(spark, path, ["ECG1", "ECG2"])
    leads = materialized(ecg.lead(named), "leads")
    names = edf.edf_headers(spark, path).select("file", F.col("patient").cast("long").alias("entity"))
    k = F.row_number().over(Window.partitionBy("entity").orderBy("us")) - 1
    stages = ev.select("entity", k.alias("k"), F.when(V() > 40, 3).otherwise(2).alias("stage")).where("k < 12")
    labels = stages.join(names, "entity").select("file", (F.col("k") * 10_000_000 - 5_000_000).cast("long").alias("us"), "stage")
    found = materialized(ecg.peaks(leads), "beats")
    judged = materialized(ecg.intervals_of(found), "intervals")
    _, summary = ecg.ingest(leads, materialized(labels, "labels"), found, judged, epoch_s=10)
    return summary.join(names, "file").drop("file")


def _dealt(key: str) -> Column:
    """The name of one of 256 folders, by a hash."""
    return F.lower(F.lpad(F.hex(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 256), 2, "0"))


@query("scan_recovered_json_all", f"{EV} SELECT t, value AS bpm, event_type AS stage FROM ev")
@query("scan_recovered_json", f"{EV} SELECT t, value AS bpm, event_type AS stage FROM ev")
def scan_recovered_json_all(ev: DataFrame) -> DataFrame:
    """Each entity has a document of rates and one of stages, written side by
    side; a task that reads a folder joins the two of each entity."""
    path = new_path(ev.sparkSession, "recovered")
    own = F.array_sort(F.collect_list(F.struct("t", V().alias("bpm"), F.col("event_type").alias("stage"))))
    rows = ev.groupBy("entity").agg(own.alias("s")).withColumn("base", F.concat_ws("/", _dealt("entity"), F.coalesce(F.col("entity").cast("string"), F.lit("none"))))
    of = lambda field: F.struct(F.concat("base", F.lit(f".{field[0]}.json")).alias("name"), F.to_json(F.transform("s", lambda x: F.struct(x["t"].alias("t"), x[field[1]].alias(field[1])))).alias("content"))
    documents.write(rows.select(F.explode(F.array(of(("hr", "bpm")), of(("stages", "stage")))).alias("f")).select("f.*"), path)
    return text.recovered(ev.sparkSession, path)


@query("list_files_all", "SELECT user_id::VARCHAR AS entity, event_type AS night FROM events GROUP BY ALL HAVING max(value) > 50")
@query("list_files", "SELECT user_id::VARCHAR AS entity, event_type AS night FROM events GROUP BY ALL HAVING max(value) > 50")
def list_files_all(ev: DataFrame) -> DataFrame:
    """Nights are written as files in folders of entities; those with a value
    above 50 have a second one. Folders are dealt over 256 others."""
    path = new_path(ev.sparkSession, "nights")
    named = lambda k, c: F.concat(F.lit(f"{k}="), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("%")))
    folder = F.concat_ws("/", _dealt("entity"), named("entity", "entity"), named("night", "event_type"))
    csv = F.struct(F.concat(folder, F.lit("/part.csv")).alias("name"), V().cast("string").alias("line"))
    json = F.struct(F.concat(folder, F.lit("/part.json")).alias("name"), F.to_json(F.struct("value")).alias("line"))
    documents.write_lines(ev.select(F.explode(F.when(V() > 50, F.array(csv, json)).otherwise(F.array(csv))).alias("l")).select("l.*"), path)
    raw = lambda c: F.split(c, "=")[1]
    name = lambda c: F.when(raw(c) != "%", F.url_decode(raw(c))).alias(c)
    return text.paired_files(ev.sparkSession, path, "*.csv", "*.json").select(name("entity"), name("night"))


@query("scan_npz_all", f"{EV} SELECT entity, count(*) AS n FROM ev GROUP BY 1")
@query("scan_npz", f"{EV} SELECT entity, count(*) AS n FROM ev GROUP BY 1")
def scan_npz_all(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "derived")
    ev.withColumn("part", F.col("entity") % 8).write.partitionBy("part").parquet(path)
    return ev.sparkSession.read.parquet(path).groupBy("entity").agg(F.count("*").alias("n"))


@query("sink_sessions_json", f"{EV}, s AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) SELECT 5::BIGINT AS count, event_type, n FROM s")
def sink_sessions_json(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "summary")
    rows = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.envelope(rows, "sessions", source=F.lit("events")).write.text(path)
    found = ev.sparkSession.read.schema("count LONG, sessions ARRAY<STRUCT<event_type: STRING, n: LONG>>").json(path)
    return found.select("count", F.explode("sessions").alias("s")).select("count", "s.*")


@query("fmt_offset", f"""{EV}, x AS (SELECT event_id, floor(value * 971)::BIGINT - 9000 AS s FROM ev), a AS (SELECT *, abs(s) AS a FROM x)
SELECT event_id, printf('%s%dh%02dm%05.2fs', CASE WHEN s < 0 THEN '-' ELSE '+' END, a // 3600, (a // 60) % 60, (a % 60)::DOUBLE) AS text FROM a""")
def fmt_offset(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", scalar.offset_text((F.floor(V() * 971) - 9000).cast("double")).alias("text"))


@query("midnight_roll", f"""{EV}, c AS (SELECT event_id, entity, us, (us // 1000000) % 86400 AS s FROM ev), f AS (SELECT *, CASE WHEN s - coalesce(lag(s) OVER (PARTITION BY entity ORDER BY us), 64800) < -3600 THEN 86400 ELSE 0 END AS roll FROM c)
SELECT event_id, (s + sum(roll) OVER (PARTITION BY entity ORDER BY us))::BIGINT AS t FROM f""")
def midnight_roll(ev: DataFrame) -> DataFrame:
    """Recordings that start at 18:00."""
    rows = ev.select("event_id", F.col("entity").alias("file"), US().alias("line"), F.date_format(F.timestamp_micros(US()), "HH:mm:ss").alias("clock"))
    return text.clock_times(rows, start_s=F.lit(64_800)).select("event_id", F.col("t").cast("long").alias("t"))


@query("date_parse", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 - 3600 END AS s FROM events")
def date_parse(ev: DataFrame) -> DataFrame:
    stamp = F.date_format(F.timestamp_micros(US()), "yyyy-MM-dd HH:mm:ss")
    written = F.concat(stamp, F.when(F.col("event_id") % 9 == 0, " late").otherwise(" +0100"))
    return ev.select("event_id", F.unix_seconds(scalar.parse_offset_time(written)).alias("s"))


@query("resample_offsets", f"""{EV}, o AS (SELECT entity, min(us) FILTER (event_type = 'error') AS o FROM ev GROUP BY 1), g AS (SELECT entity, o, k, o + k * 43200000000 AS gt FROM o, range(-3, 4) AS x(k) WHERE o IS NOT NULL),
n AS (SELECT g.*, (SELECT max(us) FROM ev WHERE ev.entity = g.entity AND us <= gt) AS u1, (SELECT min(us) FROM ev WHERE ev.entity = g.entity AND us >= gt) AS u2 FROM g)
SELECT n.entity, k, round(CASE WHEN u1 = u2 THEN a.value ELSE a.value + (b.value - a.value) * ((gt - u1)::DOUBLE / (u2 - u1)) END, 5) AS value FROM n JOIN ev a ON a.entity = n.entity AND a.us = u1 JOIN ev b ON b.entity = n.entity AND b.us = u2""")
def resample_offsets(ev: DataFrame) -> DataFrame:
    onset = ev.where("event_type = 'error'").groupBy("entity").agg(F.min("us").alias("o"))
    wanted = onset.select("entity", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("k"), "o").select("entity", F.col("k").cast("long").alias("k"), (F.col("o") + F.col("k") * 43_200_000_000).alias("us"))
    both = ev.select("entity", "us", "value", F.lit(None).cast("long").alias("k")).unionByName(wanted.withColumn("value", F.lit(None).cast("double")))
    sample = F.when(F.col("k").isNull(), F.struct("us", "value"))
    w = Window.partitionBy("entity").orderBy("us")
    near = both.select("*", F.last(sample, True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("a"), F.first(sample, True).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("b")).where("k IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    part = (US() - F.col("a.us")).cast("double") / (F.col("b.us") - F.col("a.us"))
    value = F.when(F.col("a.us") == F.col("b.us"), F.col("a.value")).otherwise(F.col("a.value") + (F.col("b.value") - F.col("a.value")) * part)
    return near.select("entity", "k", r(value, 5).alias("value"))


@query("rolling_apply", f"""{EV} SELECT event_id, round(quantile_cont(value, 0.9) OVER w - quantile_cont(value, 0.1) OVER w, 6) AS spread FROM ev WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING)""")
def rolling_apply(ev: DataFrame) -> DataFrame:
    """A function of the caller's, here a numpy one, over each centred window."""
    spread = lambda t, x: float(np.quantile(x, 0.9) - np.quantile(x, 0.1))
    return frames.rolling_apply(ev.select("event_id", "entity", "us", "value"), 2 * DAY, spread, "spread", chunk_s=10 * DAY).select("event_id", r("spread").alias("spread"))


@query("per_entity_rows", f"""{EV}, m AS (SELECT *, max(value) OVER (PARTITION BY entity ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev)
SELECT entity, us, value FROM m WHERE top IS NULL OR value > top""")
def per_entity_rows(ev: DataFrame) -> DataFrame:
    """A function of the caller's from an entity's series to any rows."""

    def highs(rows: pd.DataFrame) -> pd.DataFrame:
        before = rows["value"].cummax().shift(1)
        return rows[before.isna() | (rows["value"] > before)]

    return frames.per_entity(ev.select("entity", "us", "value"), highs, "entity long, us long, value double")


# live sources


@query("sensor_query", f"{EV} SELECT event_id FROM ev WHERE us >= 1705708800000000 AND event_type IN ('view', 'click')")
def sensor_query(ev: DataFrame) -> DataFrame:
    live = _as_stream(ev).where((US() >= 1_705_708_800_000_000) & F.col("event_type").isin("view", "click"))
    return _drained(live.select("event_id"))


@query("motion_source", f"{EV} SELECT event_id, 1704067200 + round(us / 1000000 - 1704067200)::BIGINT AS at_s FROM ev WHERE event_type = 'click'")
def motion_source(ev: DataFrame) -> DataFrame:
    boot = 1_704_067_200
    live = _as_stream(ev).where("event_type = 'click'").withColumn("uptime", US().cast("double") / 1e6 - boot)
    return _drained(live.select("event_id", (boot + F.round("uptime")).cast("long").alias("at_s")))


@query("periodic_checkpoint", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def periodic_checkpoint(ev: DataFrame) -> DataFrame:
    """Snapshots every second, and a last one when the stream is stopped: rows
    that come between two triggers aren't lost, and none is written twice."""
    spark = ev.sparkSession
    source, out, state = (new_path(spark, n) for n in ("arriving", "kept", "state"))
    ev.where("event_id % 2 = 0").write.parquet(source)
    live = spark.readStream.schema(ev.schema).parquet(source)
    running = sinks.checkpointed(live, out, state, "1 second")
    running.processAllAvailable()
    ev.where("event_id % 2 = 1").write.mode("append").parquet(source)
    return sinks.finished(running, live, out, state).groupBy("event_type").agg(F.count("*").alias("n"))


@query("state_log", f"{EV}, e AS (SELECT *, lag(event_type) OVER (PARTITION BY entity ORDER BY us) AS b FROM ev) SELECT event_id, b AS state_from, event_type AS state_to FROM e WHERE b IS NULL OR b <> event_type")
def state_log(ev: DataFrame) -> DataFrame:
    """The changes of a stream of states, each with what was before, as they come."""
    live = _as_stream(ev.select("event_id", "entity", "us", F.col("event_type").alias("state")))
    return _drained(phase.edges(live)).select("event_id", F.col("before").alias("state_from"), F.col("state").alias("state_to"))


ACTIONS = {"click": "start", "error": "failed", "purchase": "stop", "view": "rate"}


@query("session_lifecycle")
def session_lifecycle(ev: DataFrame) -> DataFrame:
    action = scalar.recode(F.col("event_type"), ACTIONS)
    return _drained(phase.lifecycle(_as_stream(ev.select("entity", "us", action.alias("action")))))


@query("edge_stream", f"{EV}, e AS (SELECT *, event_type <> coalesce(lag(event_type) OVER (PARTITION BY entity ORDER BY us), '') AS c FROM ev) SELECT event_id, event_type FROM e WHERE c")
def edge_stream(ev: DataFrame) -> DataFrame:
    live = _as_stream(ev.select("event_id", "entity", "us", F.col("event_type").alias("state")))
    return _drained(phase.edges(live)).select("event_id", F.col("state").alias("event_type"))
