"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator with its general interface; `queries` registers
the thin queries over the driver's tables.  Nothing outside this package
imports it.
"""
