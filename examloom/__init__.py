"""Question-bank and assessment analytics as Spark DataFrame jobs.

Operators are functions from DataFrames to a DataFrame.  None of them creates a
session or collects rows.  Those that store an intermediate table (a walk over
links, near-duplicate merging, whole-table numbering) say so.
"""
