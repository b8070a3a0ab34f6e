"""Operators of a training-data pipeline over ``documents`` and its side tables.

Every operator takes DataFrames and returns DataFrames; ``queries`` applies each to its whole
table. Only the columns an operator names are read, so extra columns never clash.
"""
