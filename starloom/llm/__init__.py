"""Operators for preparing training data: ten methods, their registered queries and SQL twins.

Nothing outside this package imports it. Each module has a general interface; the thin
queries in ``queries`` derive their digest columns from what the operators return.
"""
