"""Operators for large training-data pipelines.

Each module holds one operator with a general interface; ``queries`` holds the
thin contract queries and their SQL. Nothing outside this folder imports it.
"""
