"""Operators for preparing large training corpora, each built on Spark DataFrames."""
