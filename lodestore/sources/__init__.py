"""Sources: object stores as DataFrames."""
