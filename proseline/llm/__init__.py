"""Training-data operators; nothing else in the library imports this package.

``queries()`` and ``oracle_sql()`` list the driver queries of the package.
"""

from proseline.llm.registry import oracle_sql, queries  # noqa: E402

__all__ = ["oracle_sql", "queries"]
