"""Study-data quality, reporting and scheduling audit on Spark DataFrames."""

__version__ = "0.1.0"
