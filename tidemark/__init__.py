"""Tidemark: time-annotated question/answer analytics on PySpark DataFrames."""
