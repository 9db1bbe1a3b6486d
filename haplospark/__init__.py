"""haplospark: population-genomics and corpus operators written for Spark DataFrames."""

__version__ = "0.1.0"
