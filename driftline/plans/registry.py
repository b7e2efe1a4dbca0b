"""Registry of queries. The event stream stands for the sensor series: a user
is an entity, its events are samples, a row's event type is its label, and an
event opens an interval of ten minutes per unit of value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros, seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86_400
#: The same tables in SQL: samples, intervals, and days as label epochs.
EV = "ev AS (SELECT event_id, user_id AS entity, epoch_us(ts) AS us, epoch_us(ts) / 1e6::DOUBLE AS t, event_type, value, props FROM events)"
IV = EV + ", iv AS (SELECT entity, event_id, us AS start_us, us + floor(value * 10)::BIGINT * 60000000 AS end_us, event_type AS label FROM ev)"
DAYS = EV + ", d AS (SELECT *, floor(us / 86400000000)::BIGINT AS k FROM ev)"


def query(name: str, sql: str | None = None, *, of: Callable | None = None):
    """Registers ``f(table)`` under a name, where ``of(spark, sf_dir)`` makes
    the table; by default the events."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f((of or events)(spark, sf_dir))
        if sql is not None:
            SQL[name] = "WITH " + sql if not sql.lstrip().upper().startswith(("WITH", "SELECT")) else sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros(F.col("ts"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.col("user_id").alias("entity"), us.alias("us"), seconds(us).alias("t"), "event_type", "value", "props")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_intervals(events(spark, sf_dir))


def as_intervals(ev: DataFrame) -> DataFrame:
    return ev.select("entity", "event_id", F.col("us").alias("start_us"), (F.col("us") + F.floor(F.col("value") * 10) * 60_000_000).alias("end_us"), F.col("event_type").alias("label"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("k", F.floor(F.col("us") / 86_400_000_000))


def V() -> Column:  # noqa: N802
    """The value of a sample. Columns need a session, so they are made when a query runs."""
    return F.col("value")


def US() -> Column:  # noqa: N802
    return F.col("us")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")
