"""Evidence-graph analytics on PySpark: declarative operators over DataFrames."""
