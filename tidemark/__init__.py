"""tidemark: rubric scoring, segment fusion and retrieval on PySpark DataFrames."""
