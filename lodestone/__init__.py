"""Lodestone: vector collections, document queries and change logs as Spark DataFrames."""
