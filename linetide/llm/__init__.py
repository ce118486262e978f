"""Training-data operators: tokens, filters, near-duplicates, search, packing and chat formatting.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
hold one thin query per operator over the tables of a data directory.
"""

from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
