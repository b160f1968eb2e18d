"""veldspar: nearest-neighbour transaction scoring and corpus operators on Spark DataFrames."""
