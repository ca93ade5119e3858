"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` holds the queries
and SQL that ``__spark_entry__.py`` registers when the folder is present.
"""
