"""colscope: Parquet rows and Parquet footers as Spark DataFrames."""

__version__ = "0.1.0"
