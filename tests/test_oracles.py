"""Every query of the library against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from compare import assert_same
from driftline import plans


@pytest.mark.parametrize("name", sorted(plans.sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert_same(plans.queries()[name](spark, sf_dir), duck, plans.sql()[name])


def test_queries_without_sql_have_tests_of_their_own():
    """By value: in test_phase, test_scoring and test_beats."""
    assert set(plans.queries()) - set(plans.sql()) == {
        "phase_machine", "phase_machine_stream", "phase_machine_typed", "session_lifecycle", "ecg_ingest",
        "group_kfold", "logreg_auroc", "random_forest_auroc", "learnability_models", "forward_selection", "event_surface_models", "treatment_models", "depth_costs",
        "spectral_bands", "hrv_all_features",
    }


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert "tau" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
