"""maskline: span redaction and evaluation on Spark DataFrames."""
