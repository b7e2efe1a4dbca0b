"""Windows along very long series without one task per series.

Groups of at most ``rows`` rows are one chunk. A longer one is cut at quantiles
of its times into chunks of about ``rows``, each a group of its own for Spark.
Rows of one time are never parted. Two ways carry what a chunk must know:

* ``carried``: frames without a bound (everything before, everything after).
  Chunks summarise themselves, a window over summaries passes them on, and
  each chunk combines what comes from outside with its own window.
* ``widened``: frames of a bounded width. Rows are copied into the chunks that
  look at them; each chunk computes, and its copies are dropped.

Which groups are long is counted first. There are fewer of them than the table
has rows by ``rows``; where there is none, nothing is cut, joined or copied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may hold.
ROWS = 2_000_000
#: Cuts are broadcast up to so many rows by group and chunk.
SMALL = 100_000


@dataclass(frozen=True)
class Carried:
    """An aggregate over all rows on one side. ``fn`` is max, min, sum, last or
    first (these two pass over nulls); rows of the frame end at ``edge`` rows
    (or, if ``by_value``, microseconds) from the row: -1 before it, 0 with it,
    1 after it."""

    fn: str
    value: Column
    edge: int = -1
    after: bool = False
    by_value: bool = False


_AGGREGATES: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, True), "first": lambda c: F.first(c, True)}


def _combined(fn: str, inside: Column, outside: Column) -> Column:
    if fn == "max":
        return F.greatest(inside, outside)
    if fn == "min":
        return F.least(inside, outside)
    if fn == "sum":
        return F.when(inside.isNotNull() | outside.isNotNull(), F.coalesce(inside, F.lit(0)) + F.coalesce(outside, F.lit(0)))
    return F.coalesce(inside, outside)


def _keys(by: list[str]) -> Column:
    """A key that isn't null, so that null groups meet in joins."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in by]).cast("string") if len(by) > 1 else F.coalesce(F.concat(F.lit("="), F.col(by[0]).cast("string")), F.lit(""))


def long_groups(df: DataFrame, by: list[str], at: str, rows: int = ROWS) -> DataFrame | None:
    """(_g, _cuts): the times at which groups with more than ``rows`` rows are
    cut; None if there are none. Fewer than one group in ``rows`` rows."""
    sizes = df.groupBy(_keys(by).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    long = {r["_g"]: r["_n"] for r in sizes.collect()}
    if not long:
        return None
    parts = -(-max(long.values()) // rows)
    # each group takes the quantiles that its own size asks for
    table = df.sparkSession.createDataFrame([(g, -(-n // rows)) for g, n in long.items()], "_g string, _parts int")
    mine = df.withColumn("_g", _keys(by)).join(F.broadcast(table), "_g")
    all_cuts = mine.groupBy("_g", "_parts").agg(F.percentile_approx(at, F.array(*[F.lit(k / (2 * parts)) for k in range(1, 2 * parts)]), F.lit(10_000)).alias("_q"))
    picked = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda k: F.element_at("_q", F.greatest(F.lit(1), F.floor(k * F.lit(2 * parts) / F.col("_parts")).cast("int"))))
    found = all_cuts.select("_g", F.array_sort(F.array_distinct(picked)).alias("_cuts"))
    return df.sparkSession.createDataFrame(found.toArrow())  # a row for each long group


def _placed(df: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("_g", _keys(by)).join(F.broadcast(cuts), "_g", "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))


def _chunk(at: Column) -> Column:
    return F.size(F.filter("_cuts", lambda c: c <= at))


def carried(df: DataFrame, by: list[str], order: list[str], columns: dict[str, Carried], cuts: DataFrame | None) -> DataFrame:
    """``df`` with the aggregates in ``columns``, each over the rows of its group
    on one side by ``order``, whose first column is the time that ``cuts``, made
    by ``long_groups``, cut. Rows that tie in ``order`` come in any order,
    unless ``by_value``."""

    def inside(c: Carried, keys: list[str]) -> Column:
        w = Window.partitionBy(*keys).orderBy(*(order[:1] if c.by_value else order))
        ends = (c.edge, Window.unboundedFollowing) if c.after else (Window.unboundedPreceding, c.edge)
        return _AGGREGATES[c.fn](c.value).over(w.rangeBetween(*ends) if c.by_value else w.rowsBetween(*ends))

    if cuts is None:
        return df.select("*", *[inside(c, by).alias(name) for name, c in columns.items()])
    placed = _placed(df, cuts, by).withColumn("_chunk", _chunk(F.col(order[0]))).drop("_cuts")
    keys = ["_g", "_chunk"]
    # only long groups have something outside of a chunk; last and first of a chunk go by time
    long = placed.join(F.broadcast(cuts.select("_g")), "_g", "left_semi")

    def summary(name: str, c: Carried) -> Column:
        if c.fn in ("last", "first"):
            along = F.struct(*order)
            known = F.when(c.value.isNotNull(), along)
            return (F.max_by(c.value, known) if c.fn == "last" else F.min_by(c.value, known)).alias(name)
        return _AGGREGATES[c.fn](c.value).alias(name)

    sums = long.groupBy(*keys).agg(*[summary(f"_in_{name}", c) for name, c in columns.items()])
    w = Window.partitionBy("_g").orderBy("_chunk")
    sides = {False: w.rowsBetween(Window.unboundedPreceding, -1), True: w.rowsBetween(1, Window.unboundedFollowing)}
    outer = sums.select(*keys, *[_AGGREGATES[c.fn](F.col(f"_in_{name}")).over(sides[c.after]).alias(f"_out_{name}") for name, c in columns.items()])
    if cuts.select(F.sum(F.size("_cuts") + 1)).first()[0] <= SMALL:
        outer = F.broadcast(outer)
    own = placed.select("*", *[inside(c, keys).alias(f"_in_{name}") for name, c in columns.items()])
    met = own.join(outer, keys, "left")
    return met.select(*df.columns, *[_combined(c.fn, F.col(f"_in_{name}"), F.col(f"_out_{name}")).alias(name) for name, c in columns.items()])


def reached(df: DataFrame, by: list[str], at: str, before_us: int, after_us: int, cuts: DataFrame) -> DataFrame:
    """Rows copied into the chunks (_g, _chunk) that look at them, where windows
    reach ``before_us`` back and ``after_us`` ahead; a row is at home where
    _own = _chunk."""
    # a row is seen from the times at - after .. at + before
    reach = F.sequence(_chunk(F.col(at) - after_us), _chunk(F.col(at) + before_us))
    return _placed(df, cuts, by).withColumn("_own", _chunk(F.col(at))).withColumn("_chunk", F.explode(F.coalesce(reach, F.array(F.col("_own"))))).drop("_cuts")


def widened(df: DataFrame, columns: Callable[[list[str]], dict[str, Column]], before_us: int, after_us: int = 0, by: list[str] | None = None, at: str = "us", rows: int = ROWS, cuts=...) -> DataFrame:
    """``df`` with ``columns(keys)``: window expressions partitioned by ``keys``
    that look back at most ``before_us`` and ahead at most ``after_us``. A
    chunk holds, besides its own, the rows within that reach of it. ``cuts``
    are those of ``long_groups``, by default made here."""
    by = by or ["entity"]
    cuts = long_groups(df, by, at, rows) if cuts is ... else cuts
    if cuts is None:
        return df.select("*", *[c.alias(name) for name, c in columns(by).items()])
    placed = reached(df, by, at, before_us, after_us, cuts)
    done = placed.select("*", *[c.alias(name) for name, c in columns(["_g", "_chunk"]).items()])
    return done.where(F.col("_own") == F.col("_chunk")).drop("_g", "_own", "_chunk")
