"""Set-level operators over all runs: DataFrames in, DataFrames out."""
