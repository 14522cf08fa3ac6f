"""driftflow: concept-drift measurement and adaptation on Spark DataFrames.

Sub-packages
------------
sources    day tables (CSV and Parquet), fitted state, result tables
functions  scalar column expressions
operators  DataFrame-in, DataFrame-out building blocks
plans      end-to-end runs composed from the operators
registry   the named queries and the SQL they are checked against
"""
