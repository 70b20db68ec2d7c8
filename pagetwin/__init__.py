"""pagetwin: compare two collections of web pages with Spark DataFrames."""

__version__ = "0.1.0"
