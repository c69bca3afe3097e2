"""Lodestar: a Spark-native engine for evidence grids, tables and text corpora.

Every operator is a plain function from DataFrames to a DataFrame.
"""
