"""Feature analytics over wide, labelled, numeric tables as lazy PySpark DataFrames."""
