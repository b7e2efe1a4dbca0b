"""Functions of the caller's, in pandas or numpy, over windows and entities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import S


def rolling_apply(df: DataFrame, width_s: float, fn: Callable[[np.ndarray, np.ndarray], float], name: str, value: str = "value", entity: str = "entity", chunk_s: float = 86_400) -> DataFrame:
    """``df`` with ``name``: ``fn(times in seconds, values)`` of the centred
    window [t - w/2, t + w/2] of each row. Null values are left out of windows;
    empty windows give null. Chunks of ``chunk_s`` are tasks of their own, with
    half a window more on each side, so no task holds an entity's whole series."""
    half, chunk = int(width_s * S / 2), int(chunk_s * S)
    own = F.floor(F.col("us") / chunk)
    reach = F.sequence(F.floor((F.col("us") - half) / chunk), F.floor((F.col("us") + half) / chunk))
    columns = df.columns
    spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(reach))

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows[value].notna()].sort_values("us", kind="stable")
        us, x = known["us"].to_numpy(), known[value].to_numpy()
        mine = rows[rows["_own"] == rows["_chunk"]]
        low, high = np.searchsorted(us, mine["us"] - half, side="left"), np.searchsorted(us, mine["us"] + half, side="right")
        found = [fn(us[a:b] / S, x[a:b]) if b > a else None for a, b in zip(low, high, strict=True)]
        return mine[columns].assign(**{name: pd.array(found, "Float64")})

    fields = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    return spread.groupBy(entity, "_chunk").applyInPandas(apply, f"{fields}, `{name}` double")


def per_entity(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, entity: str = "entity") -> DataFrame:
    """``fn`` of each entity's rows in the order of time; it returns any rows of
    ``schema``. An entity's series is in one task, as the function wants it."""
    return df.groupBy(entity).applyInPandas(lambda rows: fn(rows.sort_values("us", kind="stable").reset_index(drop=True)), schema)
