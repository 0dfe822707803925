"""Code-intelligence, session-memory and training-data analytics on PySpark DataFrames."""
