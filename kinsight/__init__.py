"""Customer-intelligence operators for Spark: pure functions from DataFrames to DataFrames."""
