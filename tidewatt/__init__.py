"""tidewatt: a Spark-native analytics engine for interval-stamped operational data."""
