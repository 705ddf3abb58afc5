"""arcline: trajectory and event analytics on PySpark DataFrames."""
