"""Sinks: session documents, updates of documents, result cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_name(start_t: Column, session_id: Column) -> Column:
    """yyyy-MM-dd_<first 8 characters>.json"""
    return F.concat(F.date_format(F.timestamp_seconds(start_t), "yyyy-MM-dd"), F.lit("_"), F.left(session_id, F.lit(8)), F.lit(".json"))


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with the fields in the order of their names."""
    docs.select(*sorted(docs.columns)).write.mode(mode).json(path)


def upserted(docs: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """Documents with the latest non-null value of each changed field; changes
    of unknown documents are left out."""
    fields = [c for c in changes.columns if c not in (key, at)]
    last = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_{c}") for c in fields])
    return docs.join(last, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in docs.columns])


def envelope(rows: DataFrame, name: str, **fields: Column) -> DataFrame:
    """One JSON document: some fields, the number of rows, and the rows."""
    return rows.agg(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))).alias("value"))


def write_cells(cells: DataFrame, path: str, digits: int = 4) -> None:
    """One CSV with a header; numbers with a fixed number of digits. For
    result grids, whose size is that of their parameters."""
    shown = {f.name: F.format_string(f"%.{digits}f", f.name) for f in cells.schema if f.dataType.typeName() == "double"}
    (cells.withColumns(shown) if shown else cells).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def checkpointed(stream: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds"):
    """Starts a stream that writes what it has every so often (once, with all
    that there is, if ``every`` is None). A batch is a folder of its own, named
    by its number, so one that is delivered again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finished(query, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Stops a stream of ``checkpointed`` and writes a last snapshot of what came
    since the last one; gives all that was written."""
    query.stop()
    checkpointed(stream, path, checkpoint, None).awaitTermination()
    spark = stream.sparkSession
    fields = ", ".join(f"`{c}` {kind}" for c, kind in stream.dtypes)
    return spark.read.schema(f"{fields}, batch long").parquet(path).drop("batch")
