"""Operators of a training-data pipeline over a table of documents.

Nothing else in the package imports this subpackage.  Every operator takes DataFrames and
returns one; only the columns it names are read, so extra columns never clash.
"""
