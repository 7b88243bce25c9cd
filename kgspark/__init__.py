"""kgspark: knowledge-graph building, merging, measuring and querying on Spark DataFrames."""

__version__ = "0.1.0"
