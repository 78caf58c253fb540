"""Training-data operators: each module holds one operator and its registered query.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list what ``__spark_entry__.py`` adds.
"""
