"""Text formats: health exports in XML, logs, session documents, CSV series,
hypnograms. Schemas are given, never inferred."""

from __future__ import annotations

import fnmatch
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import documents
from ..functions.scalar import parse_offset_time, source_matches

RECORD = "_type STRING, _sourceName STRING, _unit STRING, _startDate STRING, _endDate STRING, _value STRING"
WORKOUT = "_workoutActivityType STRING, _startDate STRING"
CELLS = "model STRING, sustain_s INT, early_s INT, late_s INT, ff_budget DOUBLE, hit_mean DOUBLE, hit_min DOUBLE, hit_max DOUBLE, realized_ff_mean DOUBLE"
#: Fixed values of the format: the session document; all fields may be missing.
SESSION = """sessionUUID STRING, buildMarker STRING, startTimestamp DOUBLE, endTimestamp DOUBLE, endCause STRING, batteryStart FLOAT, batteryEnd FLOAT,
heartRateSamples ARRAY<STRUCT<t:DOUBLE,bpm:DOUBLE>>,
motionSamples ARRAY<STRUCT<t:DOUBLE,gx:DOUBLE,gy:DOUBLE,gz:DOUBLE,ax:DOUBLE,ay:DOUBLE,az:DOUBLE>>,
screenEvents ARRAY<STRUCT<t:DOUBLE,type:STRING>>, wristOrientationEvents ARRAY<STRUCT<t:DOUBLE,orientation:STRING>>,
workoutStateEvents ARRAY<STRUCT<t:DOUBLE,`from`:STRING,`to`:STRING>>,
experimentAudit STRUCT<pausedImmediately:BOOLEAN,activeEnergyBurnedSampleCount:INT,activeEnergyBurnedTotalKcal:DOUBLE,appleExerciseTimeSampleCount:INT,appleExerciseTimeTotalMinutes:DOUBLE>,
wakeRating STRING, followupRating STRING, followupRespondedAt DOUBLE,
algorithmDecisions ARRAY<STRUCT<t:DOUBLE,phase_from:STRING,phase_to:STRING,reason:STRING,awake_reference_hr:DOUBLE,light_ref_hr:DOUBLE,light_ref_sd:DOUBLE,current_avg_hr:DOUBLE,current_sd:DOUBLE>>,
algorithmParameters STRUCT<version:STRING,settling_to_asleep_hr_drop:DOUBLE,settling_to_asleep_sustain_s:INT,awake_reference_window_s:INT,light_reference_window_s:INT,motion_threshold_rms:DOUBLE,n_avg_s:INT,n_var_s:INT,t_hr:DOUBLE,t_var:DOUBLE,d_sustain_s:INT,d_confirm_s:INT,observeOnly:BOOLEAN>""".replace("\n", " ")
#: Fixed values of the format: what enumerated fields may hold.
ALLOWED = {
    "endCause": ("manual_wake", "backby_fired", "app_closed"),
    "wakeRating": ("sharp", "fine", "groggy", "worse"),
    "followupRating": ("still_focused", "wearing_off", "already_worn_off", "crashed"),
}


def xml_records(spark: SparkSession, path: str, kind: str | None = None, source: str | None = None, cutoff: Column | None = None) -> DataFrame:
    """(type, source, unit, start, end, value) of the ``Record`` elements of an
    export. Rows with unreadable dates are left out, and those that end before
    ``cutoff``; ``source`` is matched without case and no-break spaces."""
    rows = spark.read.format("xml").option("rowTag", "Record").schema(RECORD).load(path)
    out = rows.select(F.col("_type").alias("type"), F.col("_sourceName").alias("source"), F.col("_unit").alias("unit"), parse_offset_time(F.col("_startDate")).alias("start"), parse_offset_time(F.col("_endDate")).alias("end"), F.col("_value").alias("value"), F.col("_startDate").alias("start_text"))
    out = out.where("start IS NOT NULL AND end IS NOT NULL")
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if source is not None:
        out = out.where(source_matches(F.col("source"), source))
    return out if cutoff is None else out.where(F.col("end") >= cutoff)


def xml_workouts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "Workout").schema(WORKOUT).load(path)
    return rows.select(F.col("_workoutActivityType").alias("activity"), parse_offset_time(F.col("_startDate")).alias("start"))


def log_samples(spark: SparkSession, path: str, field: str = "eventMessage") -> DataFrame:
    """(t, bpm, uuid) of the sample lines of an NDJSON log; other lines, and
    lines that aren't JSON, are left out."""
    message = F.get_json_object("value", f"$.{field}")
    pattern = r"HR sample t=([0-9.]+) bpm=([0-9.]+) uuid=(\S+)"
    lines = spark.read.text(path).select(message.alias("m")).where(F.col("m").rlike(pattern))
    part = [F.regexp_extract("m", pattern, k) for k in (1, 2, 3)]
    return lines.select(part[0].try_cast("double").alias("t"), part[1].try_cast("double").alias("bpm"), part[2].alias("uuid")).where("t IS NOT NULL AND bpm IS NOT NULL")


def sessions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(SESSION).option("multiLine", multi_line).json(path)


def session_samples(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("sessionUUID").alias("entity"), F.explode("heartRateSamples").alias("s")).select("entity", F.col("s.t").alias("t"), F.col("s.bpm").alias("bpm"))


def disallowed(docs: DataFrame) -> DataFrame:
    """(entity, field, value) of enumerated fields with a value that isn't one of theirs."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.when(~F.col(k).isin(*v), F.col(k)).alias("value")) for k, v in ALLOWED.items()])
    return docs.select(F.col("sessionUUID").alias("entity"), F.explode(pairs).alias("p")).select("entity", "p.*").where("value IS NOT NULL")


def csv_series(spark: SparkSession, path: str) -> DataFrame:
    """(entity, night, t, value) of headerless <entity>/<night>/*.csv files;
    blank, short and non-numeric rows are left out."""
    rows = spark.read.schema("t DOUBLE, value DOUBLE").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path)
    parts = F.split(F.input_file_name(), "/")
    return rows.select(F.element_at(parts, -3).alias("entity"), F.element_at(parts, -2).alias("night"), "t", "value").where("t IS NOT NULL AND value IS NOT NULL")


def header_csv(spark: SparkSession, path: str, schema: str, gate: str | None = None) -> DataFrame:
    """A CSV with a header; ``gate`` is a condition on its rows. nan, inf and
    empty cells of numbers are null."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    tidy = {f.name: F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) < float("inf")), F.col(f.name)) for f in rows.schema if f.dataType.typeName() == "double"}
    rows = rows.withColumns(tidy) if tidy else rows
    return rows if gate is None else rows.where(gate)


def paired_files(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Folders below ``path`` that hold both files, in the order of their
    numbers: entity, night, first, second. Patterns are those of the shell; a
    task lists whole folders and pairs what each holds."""

    def pairs(_, folder: str, names: list[str]) -> Iterator[tuple]:
        parts = folder.split("/")
        both = [[n for n in names if fnmatch.fnmatchcase(n, pattern)] for pattern in (first, second)]
        for a, b in itertools.product(*both):
            yield parts[-2], parts[-1], f"{folder}/{a}", f"{folder}/{b}"

    columns = ["entity", "night", "first", "second"]
    found = documents.walked(spark, path, pairs, [(c, pa.string()) for c in columns], ", ".join(f"{c} string" for c in columns))
    return found.orderBy("entity", F.col("night").try_cast("int"), "night")


def recovered(spark: SparkSession, path: str) -> DataFrame:
    """(t, bpm, stage) of all pairs of ``{base}.hr.json`` and
    ``{base}.stages.json`` below ``path``, each an array of samples. Samples of
    equal times are joined one to one, in the order of the documents; a base
    without either document, and a time without either sample, have no row."""
    number = lambda v: None if v is None else float(v)

    def joined(system: fs.FileSystem, folder: str, names: list[str]) -> Iterator[tuple]:
        def samples(name: str, field: str) -> dict[tuple[float, int], object]:
            with system.open_input_file(f"{folder}/{name}") as file:
                rows = json.loads(file.read())
            seen: dict[float, int] = {}
            out = {}
            for row in rows:
                t = number(row.get("t"))
                if t is not None:
                    out[t, seen.setdefault(t, 0)] = row.get(field)
                    seen[t] += 1
            return out

        held = set(names)
        for name in names:
            base = name.removesuffix(".hr.json")
            if base != name and f"{base}.stages.json" in held:
                rates, stages = samples(name, "bpm"), samples(f"{base}.stages.json", "stage")
                for at, rate in rates.items():
                    if at in stages:
                        yield at[0], number(rate), stages[at]

    return documents.walked(spark, path, joined, [("t", pa.float64()), ("bpm", pa.float64()), ("stage", pa.string())], "t double, bpm double, stage string")


def hypnogram(spark: SparkSession, path: str, stages: dict[str, int], unknown: int = 5) -> DataFrame:
    """(file, line, clock, duration_s, stage) of the sleep events of
    tab-separated Latin-1 exports, whose table begins after a header line that
    starts with ``Sleep Stage``. Columns are found by the header's names."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("value"))
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).withColumn("cells", F.transform(F.split("text", "\t"), lambda c: F.trim(c)))
    head = lines.where(F.col("text").startswith("Sleep Stage")).groupBy("file").agg(F.min_by("cells", "line").alias("head"), F.min("line").alias("top"))
    rows = lines.join(head, "file").where("line > top")

    def column(name: str) -> Column:
        at = F.array_position(F.transform("head", lambda h: h.startswith(name)), True)
        return F.when(at > 0, F.get("cells", (at - 1).cast("int")))

    found = rows.select("file", "line", column("Event").alias("event"), column("Time").alias("clock"), column("Duration").try_cast("double").alias("duration_s")).where(F.col("event").startswith("SLEEP-"))
    table = F.create_map(*[F.lit(x) for pair in stages.items() for x in pair])
    return found.withColumn("stage", F.coalesce(F.try_element_at(table, "event"), F.lit(unknown)))


def clock_times(rows: DataFrame, file: str = "file", order: str = "line", clock: str = "clock", start_s: Column | None = None) -> DataFrame:
    """Adds t: seconds since the midnight before the recording's start. A clock
    that lies more than an hour before the one before it, or, in the first row,
    before the start, has passed midnight. ``start_s``: the start's seconds
    since midnight; without it the first row starts the recording."""
    parts = F.split(clock, "[:.]")
    s = F.get(parts, F.lit(0)).cast("int") * 3600 + F.get(parts, F.lit(1)).cast("int") * 60 + F.get(parts, F.lit(2)).cast("int")
    w = Window.partitionBy(file).orderBy(order)
    timed = rows.withColumn("_s", s)
    before = F.lag("_s").over(w) if start_s is None else F.coalesce(F.lag("_s").over(w), start_s)
    flagged = timed.withColumn("_roll", F.when(F.col("_s") - before < -3600, 86_400).otherwise(0))
    return flagged.withColumn("t", F.col("_s") + F.sum("_roll").over(w)).drop("_s", "_roll")


def dense_epochs(events: DataFrame, epoch_s: float, end_t: Column, unknown: int = 5, file: str = "file") -> DataFrame:
    """(file, k, stage): every epoch from the first event to the last, gaps as
    unknown; epochs that don't lie wholly before ``end_t`` are trimmed."""
    first = F.min("t").over(Window.partitionBy(file))
    placed = events.withColumn("_0", first).withColumn("k", F.bround((F.col("t") - F.col("_0")) / epoch_s).cast("long")).withColumn("_end", end_t)
    last = placed.groupBy(file).agg(F.max("k").alias("_last"), F.first("_0").alias("_0"), F.max("_end").alias("_end"))
    every = last.select(file, "_0", "_end", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("k")).where(F.col("_0") + (F.col("k") + 1) * epoch_s <= F.col("_end"))
    known = placed.groupBy(file, "k").agg(F.min("stage").alias("stage"))
    return every.join(known, [file, "k"], "left").select(file, "k", F.coalesce("stage", F.lit(unknown)).alias("stage"))
