"""Code-intelligence retrieval and corpus analytics on PySpark DataFrames."""
