"""Early-warning analytics over time-stamped measurements, on PySpark DataFrames."""
