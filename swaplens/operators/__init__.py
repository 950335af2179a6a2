"""Engine operators: DataFrames in, a lazy DataFrame out."""
