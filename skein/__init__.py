"""skein: retrieval and code-relationship analytics on PySpark DataFrames."""
