"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries`` registers one query for each operator, with its SQL
where SQL can say the same.
"""
