"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` of
:mod:`loomline.llm.queries` are what the driver entry picks up.
"""
