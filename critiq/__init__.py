"""Review analytics as Spark batch and streaming jobs: every operator maps DataFrames to a DataFrame."""
