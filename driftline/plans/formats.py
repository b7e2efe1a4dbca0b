"""Sources, sinks and streams: the event stream is written in each format to
the shared folder, and read back by the source under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import documents, sinks
from ..operators import stats
from ..params import PhaseRules
from ..shared import new_path
from ..sources import text
from ..streaming import phase, typed
from .registry import EV, US, V, query

STAMP = "date_format(timestamp_micros(us div 1000000 * 1000000), 'yyyy-MM-dd HH:mm:ss')"


def _xml(ev: DataFrame) -> str:
    path = new_path(ev.sparkSession, "export")
    rows = ev.select(
        F.col("event_type").alias("_type"), F.when(F.col("entity") % 2 == 0, f"Robin's{chr(0xA0)}Watch").otherwise("Phone").alias("_sourceName"), F.lit("count").alias("_unit"),
        F.expr(f"concat({STAMP}, ' +0000')").alias("_startDate"), F.expr(f"concat({STAMP}, CASE WHEN event_id % 50 = 0 THEN ' ?' ELSE ' -0100' END)").alias("_endDate"), F.col("event_id").cast("string").alias("_value"),
    )
    rows.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    return path


XML = f"{EV}, x AS (SELECT event_id, event_type AS type, entity % 2 = 0 AS watch, us // 1000000 AS start_s, us // 1000000 + 3600 AS end_s FROM ev WHERE event_id % 50 <> 0)"


@query("scan_xml_records", f"{XML} SELECT event_id::VARCHAR AS value, start_s, end_s FROM x WHERE type = 'error' AND watch AND end_s >= 1705708800")
def scan_xml_records(ev: DataFrame) -> DataFrame:
    found = text.xml_records(ev.sparkSession, _xml(ev), "error", "watch", F.timestamp_seconds(F.lit(1_705_708_800)))
    return found.select("value", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"))


@query("scan_xml_multi", f"{XML} SELECT type, count(*) AS n, min(start_s) AS first_s FROM x WHERE type IN ('error', 'view', 'click') GROUP BY 1")
def scan_xml_multi(ev: DataFrame) -> DataFrame:
    rows = text.xml_records(ev.sparkSession, _xml(ev)).where(F.col("type").isin("error", "view", "click"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min(F.unix_seconds("start")).alias("first_s"))


@query("scan_xml_summary", f"{XML} SELECT type, watch, count(*) AS n FROM x GROUP BY ALL")
def scan_xml_summary(ev: DataFrame) -> DataFrame:
    rows = text.xml_records(ev.sparkSession, _xml(ev))
    return rows.groupBy("type", F.col("source").endswith("Watch").alias("watch")).agg(F.count("*").alias("n"))


@query("scan_ndjson_log", f"{EV} SELECT t, value AS bpm, event_id::VARCHAR AS uuid FROM ev WHERE event_id % 7 <> 0")
def scan_ndjson_log(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "log")
    message = F.concat(F.lit("HR sample t="), F.format_string("%.6f", "t"), F.lit(" bpm="), V().cast("string"), F.lit(" uuid="), F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 7 == 0, "not json {").otherwise(F.to_json(F.struct(message.alias("eventMessage"))))
    ev.select(line.alias("value")).write.text(path)
    return text.log_samples(ev.sparkSession, path)


def _documents(ev: DataFrame) -> DataFrame:
    samples = F.array_sort(F.collect_list(F.struct("t", V().alias("bpm"))))
    grouped = ev.groupBy(F.col("entity").cast("string").alias("sessionUUID")).agg(F.min("t").alias("startTimestamp"), F.max("t").alias("endTimestamp"), samples.alias("heartRateSamples"))
    cause = F.when(F.col("sessionUUID").endswith("3"), "unknown").otherwise("manual_wake")
    return grouped.withColumn("endCause", cause)


@query("scan_session_json", f"{EV} SELECT entity::VARCHAR AS entity, t, value AS bpm FROM ev")
def scan_session_json(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "sessions")
    sinks.write_documents(_documents(ev), path)
    return text.session_samples(text.sessions(ev.sparkSession, path, multi_line=False))


@query("allowed_values", "SELECT DISTINCT user_id::VARCHAR AS entity, 'endCause' AS field, 'unknown' AS value FROM events WHERE user_id % 10 = 3")
def allowed_values(ev: DataFrame) -> DataFrame:
    return text.disallowed(_documents(ev).withColumn("wakeRating", F.lit("fine")).withColumn("followupRating", F.lit(None).cast("string")))


@query("sink_session_json", f"{EV}, s AS (SELECT entity, min(t) AS t FROM ev GROUP BY 1) SELECT strftime(make_timestamp(floor(t * 1e6)::BIGINT), '%Y-%m-%d') || '_' || left(entity || '-session', 8) || '.json' AS name FROM s")
def sink_session_json(ev: DataFrame) -> DataFrame:
    """A file for each session's document, and their names as the folder has them."""
    path = new_path(ev.sparkSession, "documents")
    documents.put(documents.named(_documents(ev).withColumn("sessionUUID", F.concat("sessionUUID", F.lit("-session")))), path)
    return documents.names(ev.sparkSession, path)


@query("document_upsert", f"{EV}, d AS (SELECT entity, min(event_type) AS rating FROM ev GROUP BY 1), c AS (SELECT entity, arg_max(event_type, us) AS rating FROM ev WHERE value > 60 GROUP BY 1) SELECT d.entity, coalesce(c.rating, d.rating) AS rating FROM d LEFT JOIN c USING (entity)")
def document_upsert(ev: DataFrame) -> DataFrame:
    """Ratings set in stored documents, a third of which have the older name."""
    spark, path = ev.sparkSession, new_path(ev.sparkSession, "documents")
    key = F.format_string("%08d-session", F.col("entity"))
    docs = ev.groupBy("entity").agg(F.min("event_type").alias("rating"), F.min("t").alias("startTimestamp")).withColumn("sessionUUID", key)
    stored = documents.named(docs).withColumn("entity", F.get_json_object("value", "$.entity").cast("long")).withColumn("key", F.get_json_object("value", "$.sessionUUID"))
    documents.put(stored.select(F.when(F.col("entity") % 3 == 0, F.concat("key", F.lit(".json"))).otherwise(F.col("name")).alias("name"), "value"), path)
    documents.changed(spark, path, ev.where("value > 60").select(key.alias("sessionUUID"), F.col("event_type").alias("rating"), "us"), "sessionUUID", "us")
    read = documents.loaded(spark, path).select("name", F.from_json("value", "entity LONG, rating STRING").alias("d"))
    # a document that was found by its older name has a newer one now
    newest = F.max_by("d.rating", F.col("name").contains("_"))
    return read.groupBy(F.col("d.entity").alias("entity")).agg(newest.alias("rating"))


@query("scan_hr_csv", f"{EV} SELECT t, value FROM ev WHERE event_id % 11 <> 0")
def scan_hr_csv(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "series")
    line = F.when(F.col("event_id") % 22 == 0, "bad,row").when(F.col("event_id") % 11 == 0, "7").otherwise(F.concat_ws(",", F.format_string("%.6f", "t"), V().cast("string")))
    ev.select(line.alias("value")).write.text(path)
    return text.csv_series(ev.sparkSession, path).select("t", "value")


@query("scan_csv_dict", f"{EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS sep FROM ev WHERE event_id % 5 = 0")
def scan_csv_dict(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "table")
    flag = F.when(F.col("event_id") % 5 == 0, "True").otherwise("False")
    ev.select("event_id", flag.alias("usable"), F.when(F.col("event_id") % 3 == 0, F.lit("nan")).otherwise(V().cast("string")).alias("sep")).write.option("header", True).csv(path)
    rows = text.header_csv(ev.sparkSession, path, "event_id LONG, usable STRING, sep DOUBLE", "usable = 'True'")
    return rows.select("event_id", "sep")


@query("sink_csv_cells", "SELECT event_type AS model, count(*) AS n, printf('%.4f', quantile_cont(value, 0.5)) AS med FROM events GROUP BY 1")
def sink_csv_cells(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "cells")
    rows = ev.withColumn("model", F.col("event_type"))
    medians = stats.ranked_quantiles(rows, "value", {"med": 0.5}, ["model"])
    sinks.write_cells(rows.groupBy("model").agg(F.count("*").alias("n")).join(medians, "model").select("model", "n", "med"), path)
    return ev.sparkSession.read.schema("model STRING, n LONG, med STRING").option("header", True).csv(path)


@query("scan_hypnogram", f"{EV} SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 0 ELSE 5 END AS stage FROM ev")
def scan_hypnogram(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "hypnograms")
    head = ["Recording of a night", "", "Sleep Stage\tTime [hh:mm:ss]\tEvent\tDuration[s]\tLocation"]
    row = F.concat_ws("\t", F.lit("x"), F.expr("date_format(timestamp_micros(us), 'HH.mm.ss')"), F.concat(F.lit("SLEEP-"), "event_type"), F.col("event_id").cast("string"), F.lit("ECG"))
    body = ev.groupBy("entity").agg(F.concat_ws("\n", *map(F.lit, head), F.concat_ws("\n", F.array_sort(F.collect_list(row)))).alias("value"))
    body.select("value").repartition(200).write.option("maxRecordsPerFile", 1).text(path)
    found = text.hypnogram(ev.sparkSession, path, {"SLEEP-error": 3, "SLEEP-view": 0})
    return found.select(F.col("duration_s").cast("long").alias("event_id"), "stage")


# streams


def _as_stream(ev: DataFrame) -> DataFrame:
    path = new_path(ev.sparkSession, "stream")
    ev.write.parquet(path)
    return ev.sparkSession.readStream.schema(ev.schema).parquet(path)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream over files gives, once it has read them all."""
    spark = stream.sparkSession
    out = new_path(spark, "drained")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("dedup_by_id", "SELECT DISTINCT event_id FROM events")
def dedup_by_id(ev: DataFrame) -> DataFrame:
    twice = ev.select("event_id", "us").unionByName(ev.where("event_id % 3 = 0").select("event_id", "us"))
    return _drained(phase.one_each(_as_stream(twice), "event_id")).select("event_id")


@query("stream_bins", "SELECT event_type, epoch_us(ts) // 86400000000 AS b, count(*) AS n FROM events GROUP BY ALL")
def stream_bins(ev: DataFrame) -> DataFrame:
    counted = _as_stream(ev).groupBy("event_type", F.floor(US() / 86_400_000_000).alias("b")).agg(F.count("*").alias("n"))
    return _drained(counted, "complete")


#: Rules of the phase machine on the scale of days.
DAYS_RULES = PhaseRules(reference_s=5 * 86_400, onset_drop=2, onset_window_s=3 * 86_400, motion_rms=60, mean_window_s=3 * 86_400, spread_window_s=3 * 86_400, deep_drop=5, max_spread=25, hold_s=86_400, confirm_s=43_200)


def _samples(ev: DataFrame) -> DataFrame:
    """Samples, and an hour before an entity's first one the start of its session."""
    rows = ev.select("entity", "us", F.when(F.col("event_type") == "click", "motion").otherwise("value").alias("kind"), "value")
    starts = ev.groupBy("entity").agg((F.min("us") - 3_600_000_000).alias("us")).select("entity", "us", F.lit("start").alias("kind"), F.lit(None).cast("double").alias("value"))
    return rows.unionByName(starts)


@query("phase_machine")
def phase_machine(ev: DataFrame) -> DataFrame:
    return phase.phase_decisions(_samples(ev), DAYS_RULES).select("entity", "us", "phase_from", "phase_to", "reason")


@query("phase_machine_stream")
def phase_machine_stream(ev: DataFrame) -> DataFrame:
    return _drained(phase.phase_stream(_as_stream(_samples(ev)), DAYS_RULES)).select("entity", "us", "phase_from", "phase_to", "reason")


@query("phase_machine_typed")
def phase_machine_typed(ev: DataFrame) -> DataFrame:
    """As ``phase_machine_stream``, with typed state in RocksDB."""
    with typed.rocksdb(ev.sparkSession):
        return _drained(typed.phase_stream(_as_stream(_samples(ev)), DAYS_RULES)).select("entity", "us", "phase_from", "phase_to", "reason")


@query("dedup_by_session", f"""{EV}, m AS (SELECT entity, us, event_type, floor(value)::BIGINT AS id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY entity ORDER BY us) AS session FROM ev)
SELECT entity, id, min(us) AS us FROM m WHERE event_type <> 'signup' GROUP BY entity, session, id""")
def dedup_by_session(ev: DataFrame) -> DataFrame:
    """Samples with an id that is new in the session, which a signup begins."""
    kind = F.when(F.col("event_type") == "signup", "start").otherwise("value")
    rows = ev.select("entity", "us", kind.alias("kind"), F.floor("value").alias("id"))
    with typed.rocksdb(ev.sparkSession):
        return _drained(typed.once_a_session(_as_stream(rows))).select("entity", "id", "us")


@query("delayed_timer", f"""{EV}, s AS (SELECT event_id, us + 10800000000 AS due_us, max(us) OVER () AS now FROM ev WHERE event_type = 'signup') SELECT event_id, due_us FROM s WHERE due_us // 1000 < now // 1000""")
def delayed_timer(ev: DataFrame) -> DataFrame:
    """Follow-ups three hours after a rating, as far as the stream has got."""
    live = _as_stream(ev.where("event_type = 'signup'").select("entity", F.col("event_id").alias("id"), "us"))
    return _drained(phase.due_timers(live, 3 * 3600)).select(F.col("id").alias("event_id"), "due_us")
