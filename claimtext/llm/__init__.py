"""Operators of a training-data pipeline over a documents table.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``queries`` registers one query per operator.
"""
