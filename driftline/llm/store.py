"""Tables in the folder that driver and executors share, and Arrow batches.

Operators that need an intermediate result twice write it there as Parquet,
which also cuts the lineage: a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from ..shared import drop, new_path
from ..shared import materialized as written

__all__ = ["ARROW_BATCH_BYTES", "bounded_batches", "drop", "new_path", "slices", "written"]

#: Arrow batches are bounded by bytes, because one text may be as long as a
#: thousand others.
ARROW_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds Arrow batches of this session to ``ARROW_BATCH_BYTES``. Spark reads
    the setting when a query runs, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of a few rows is in memory at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
