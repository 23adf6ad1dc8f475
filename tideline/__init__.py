"""Analytics on sensor time series as Spark jobs."""
