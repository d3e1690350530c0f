"""Operators of a training-data pipeline: one module per operator.

Nothing outside this subpackage imports it; ``queries`` holds the thin
registered queries and their SQL.
"""
