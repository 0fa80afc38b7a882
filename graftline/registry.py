"""All queries of the engine over the tables of a data folder, and the SQL that states each one."""

from .plans import files_queries  # noqa: F401  registers its queries
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
