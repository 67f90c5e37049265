"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``registry.queries()`` gives the
production queries and ``registry.oracle_sql()`` their DuckDB equivalents.
"""
