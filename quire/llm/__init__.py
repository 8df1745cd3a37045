"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Every operator works on plain
DataFrames; the ``opN_*`` queries in :mod:`quire.llm.queries` bind them to the
driver's tables.
"""
