"""matriq: annotated sparse matrices as Spark DataFrames."""

__version__ = "0.1.0"
