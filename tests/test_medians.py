"""Sliding medians against percentiles over range frames and a plain loop."""

from __future__ import annotations

import random
import time
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import medians, series

S = 1_000_000


@pytest.fixture(scope="module")
def samples(spark):
    """A third of all rows in one entity, a null entity, ties, nulls, a row without a time."""
    rng = random.Random(5)
    rows = [(e, rng.randrange(30 * n) * S, rng.choice([None, float(rng.randint(0, 9)), rng.random()]), [e or 0]) for e, n in [(1, 300), (None, 90), *[(k, 11) for k in range(2, 50)]] for _ in range(n)]
    return spark.createDataFrame([(k, *row) for k, row in enumerate([*rows, (1, None, 3.0, [1]), (60, 5, None, [1])])], "id long, entity long, us long, value double, more array<long>").cache()


@pytest.mark.parametrize("before_s, after_s", [(120, 0), (300, 300), (0, 60), (0, 0)])
@pytest.mark.parametrize("rows", [25, 1 << 40])
def test_equals_a_percentile_over_the_frame(samples, rows, before_s, after_s):
    w = series.along().rangeBetween(-before_s * S, after_s * S)
    want = samples.where("us IS NOT NULL").select("id", F.percentile("value", F.lit(0.5)).over(w).alias("m"))
    got = medians.sliding_median(samples, "m", before_s * S, after_s * S, rows=rows)
    assert got.columns == [*samples.columns, "m"] and got.select("more").schema == samples.select("more").schema
    want, got = ({r["id"]: r["m"] and round(r["m"], 9) for r in df.collect()} for df in (want, got))
    assert got.pop(len(got) - 2) is None  # the row without a time
    assert got == want


def test_values_that_are_not_finite_do_not_count(spark):
    rows = [(1, k * S, x) for k, x in enumerate([1.0, float("nan"), float("inf"), 4.0, float("-inf")])]
    df = spark.createDataFrame(rows, "entity long, us long, value double")
    assert [r["m"] for r in medians.sliding_median(df, "m", 10 * S).orderBy("us").collect()] == [1.0, 1.0, 1.0, 2.5, 2.5]
    assert medians.sliding_median(df.limit(0), "m", 10 * S).collect() == []


def test_the_cost_of_a_row_hardly_depends_on_the_width():
    rng = np.random.default_rng(3)
    us, x = np.arange(200_000, dtype=np.int64), rng.random(200_000)

    def seconds(width):
        begin = time.perf_counter()
        found = medians.medians(us, x, width, 0)
        for k in (0, 777, 199_999):
            assert found[k] == median(x[max(0, k - width) : k + 1])
        return time.perf_counter() - begin

    seconds(10)
    assert seconds(50_000) < 40 * seconds(50)  # a thousandfold width
