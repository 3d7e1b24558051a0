"""DataFrame operators. Each takes and returns DataFrames; only model fitting runs jobs by itself."""
