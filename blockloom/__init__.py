"""Versioned block analytics on PySpark: content-addressed storage, delta planning and rebuild of archives as DataFrames."""
