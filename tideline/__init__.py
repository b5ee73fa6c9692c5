"""A Spark-native analytics engine for event, time-series and relational data."""
