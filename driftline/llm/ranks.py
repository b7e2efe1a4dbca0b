"""Running sums over huge groups without one task per group.

A window over a group puts the group in one task. Here each group is cut into
buckets by a uniform order key; bucket totals, a small table, are summed up
first, and the window then runs within buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spread

#: Order keys lie in 0 .. SPAN - 1.
SPAN = 1 << 30


def order_key(*columns: Column) -> Column:
    """A uniform integer in 0 .. SPAN - 1 that reruns agree on, the same in
    other engines: the first bits of an MD5 sum."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 2)


def running(df: DataFrame, group: str, key: str, then: list[str], amount: Column, name: str, per_bucket: int = 20_000) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of the same
    ``group`` that come before, by ``key`` and the columns in ``then``. ``key``
    must be uniform in 0 .. SPAN - 1; a bucket holds ``per_bucket`` rows of
    all groups on average, whatever a group's size. Rows that tie in all of
    these come in any order. ``df`` is read twice, so it should be a written
    table."""
    buckets = max(1, -(-df.count() // per_bucket))
    return spread.running(df, group, F.floor(F.col(key) * buckets / SPAN).cast("long"), [key, *then], amount, name)
