"""Set-based operators: DataFrames in, one DataFrame out."""
