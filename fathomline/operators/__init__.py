"""Table operators: DataFrames in, DataFrame out; no action, clock or random number inside."""
