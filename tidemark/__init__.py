"""A versioned, ordered store and its query operators on PySpark DataFrames."""
