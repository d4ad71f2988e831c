"""A Spark-native analytics engine: functions from DataFrames to DataFrames."""
