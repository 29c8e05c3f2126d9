"""Panel analytics on Spark: panels, past-only features, labels, evaluation, triage."""
