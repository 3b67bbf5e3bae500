"""millrace: retrieval experiments as Spark DataFrames."""

__version__ = "0.1.0"
