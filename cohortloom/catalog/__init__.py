"""Every operator and mart as a named query over the star-schema tables, with an SQL equivalent.

Importing the modules below fills the registry.
"""

from cohortloom.catalog import (  # noqa: F401
    agents,
    clients,
    clusters,
    joins,
    selection,
    storage,
    studies,
    totals,
    windows,
)
from cohortloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
