"""Point-cloud, trajectory and sensor-stream analytics on Spark DataFrames."""
