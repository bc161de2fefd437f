"""Training-data operators: deduplication, token files, scoring, packing and archives.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()`` of
``tessera.llm.queries`` register its queries.
"""
