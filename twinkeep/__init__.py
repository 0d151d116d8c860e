"""Keeping copies of tables in step, and proving that they are, on Spark.

Every operator is a function from DataFrames to a DataFrame; the few that
write (syncs, sinks, streams) take an explicit target and return an outcome.
"""
