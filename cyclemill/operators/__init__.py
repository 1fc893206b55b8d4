"""The analyses. `frames` has their DataFrames; `analyses` collects these into results."""
