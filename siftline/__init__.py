"""Detection-evaluation analytics on DataFrames."""
