"""Operators for preparing large training corpora.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries.py`` binds them to the test tables.
"""
