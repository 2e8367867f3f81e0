"""Stratalog: analytics over archive and file-catalogue rows, on Spark DataFrames."""
