"""Operators that prepare text corpora for model training, each over DataFrames of any size."""
