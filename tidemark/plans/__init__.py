"""Dataset builders: Silver, daily metrics, Gold, BI, features, scores."""
