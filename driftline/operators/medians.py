"""Sliding medians whose cost per row grows with the logarithm of the window.

A percentile over a range frame collects and sorts each frame anew: rows times
width. Here an entity's rows, or a chunk of a very long entity with the rows
that its windows reach, are one Arrow group, and a sorted structure takes rows
in and out as the window slides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

from .chunks import ROWS, long_groups, reached


class _Bounds(BaseIndexer):
    """Windows that begin and end at given places, both of which only grow."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        super().__init__()
        self.start, self.end = start, end

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def medians(us: np.ndarray, values: np.ndarray, before_us: int, after_us: int) -> np.ndarray:
    """For each of the ascending times the median of values in [t - before,
    t + after]; NaN where there is none. NaN values don't count."""
    start, end = np.searchsorted(us, us - before_us, side="left"), np.searchsorted(us, us + after_us, side="right")
    return pd.Series(values).rolling(_Bounds(start.astype(np.int64), end.astype(np.int64)), min_periods=1).median().to_numpy()


def sliding_median(df: DataFrame, name: str, before_us: int, after_us: int = 0, value: str = "value", entity: str = "entity", at: str = "us", rows: int = ROWS, cuts=...) -> DataFrame:
    """``df`` with ``name``: the median of ``value`` over the entity's rows with
    times in [t - before, t + after], bounds included, rows of one time all
    alike. Values that are null or not finite don't count; windows without one
    and rows without a time give null; null entities are one series. Other
    columns pass through as they are. ``cuts``: as in ``chunks.widened``."""
    cuts = long_groups(df, [entity], at, rows) if cuts is ... else cuts
    placed, by = (df, [entity]) if cuts is None else (reached(df, [entity], at, before_us, after_us, cuts), ["_g", "_chunk"])
    columns, whole = df.columns, cuts is None  # no DataFrame goes with the function

    def apply(group: pa.Table) -> pa.Table:
        when = group.column(at).to_numpy()
        known = group.column(at).is_valid().to_numpy()
        x = group.column(value).cast(pa.float64()).to_numpy()
        places = np.flatnonzero(known)
        places = places[np.argsort(when[places], kind="stable")]
        out = np.full(len(x), np.nan)
        out[places] = medians(when[places].astype(np.int64), np.where(np.isfinite(x), x, np.nan)[places], before_us, after_us)
        done = group.select(columns).append_column(name, pa.array(out, from_pandas=True))
        return done if whole else done.filter(pa.array(group.column("_own").to_numpy() == group.column("_chunk").to_numpy()))

    return placed.groupBy(*by).applyInArrow(apply, StructType([*df.schema.fields]).add(name, DoubleType()))
