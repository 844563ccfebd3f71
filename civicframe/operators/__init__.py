"""Table operators: DataFrames in, DataFrames out, nothing run on the driver."""
