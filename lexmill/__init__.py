"""Lexmill: academic-document normalization and corpus queries, expressed as Spark DataFrames."""
