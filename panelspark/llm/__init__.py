"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this subpackage.  Every operator takes and returns
DataFrames, keeps the rows it is not asked to drop, and holds no state on the driver that
grows with the documents.
"""
