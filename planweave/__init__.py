"""Knowledge-graph construction and analytics over emergency-plan texts, on Spark DataFrames."""

__version__ = "0.1.0"
