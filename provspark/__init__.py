"""provspark: set-wise image-provenance analytics on PySpark DataFrames."""

__version__ = "0.1.0"
