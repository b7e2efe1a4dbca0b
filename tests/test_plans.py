"""Physical plans: what is read, and how often rows move."""

from __future__ import annotations

import re

import pytest

from driftline import plans


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, sf_dir):
    p = plan(plans.queries()["count_by_key"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<event_type:string>", p)
    p = plan(plans.queries()["within_group_spread"](spark, sf_dir))
    assert "o_orderdate" not in re.search(r"ReadSchema: (\S+)", p)[1]


def test_filters_reach_the_scan(spark, sf_dir):
    p = plan(plans.queries()["label_set_union"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type", p)


@pytest.mark.parametrize("name", ["trailing_sd", "centred_rolling", "decision_points", "next_event_asof", "interval_union", "cadence", "boxcar15"])
def test_one_shuffle_per_entity(name, spark, sf_dir):
    """All windows and aggregates of a series share one partitioning."""
    p = plan(plans.queries()[name](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and "BatchEvalPython" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["best_overlap_match", "sample_in_interval", "fire_in_interval", "event_coincidence"])
def test_range_joins_have_equal_keys(name, spark, sf_dir):
    p = plan(plans.queries()[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_numbering_is_not_one_window(spark, sf_dir):
    p = plan(plans.queries()["natural_sort"](spark, sf_dir))
    assert "SinglePartition" not in p


def test_edges_are_not_fed_through_one_task(spark, sf_dir, monkeypatch):
    from driftline.plans import recordings

    fed, whole = [], recordings._as_stream
    monkeypatch.setattr(recordings, "_as_stream", lambda rows: fed.append(plan(rows)) or whole(rows))
    plans.queries()["edge_stream"](spark, sf_dir)
    assert len(fed) == 1 and "Coalesce" not in fed[0]
