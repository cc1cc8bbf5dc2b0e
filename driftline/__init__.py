"""driftline: Spark-native analytics for many noisy, irregular entity time series."""
