"""DataFrame operators: each takes and returns DataFrames and never collects rows."""
