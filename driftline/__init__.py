"""driftline: Spark jobs over irregular, per-entity time series and labelled intervals."""
