"""tidemark: leakage-safe analytics and large-table data processing on PySpark DataFrames."""

__version__ = "0.1.0"
