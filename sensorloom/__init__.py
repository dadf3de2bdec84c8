"""Sensor time-series and anomaly analytics on Spark DataFrames."""
