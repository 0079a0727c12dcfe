"""Expression analytics on Spark: formulas as text become Columns and DataFrames."""
