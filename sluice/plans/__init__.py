"""Tables, queries and the environment that runs them."""

from .env import JobHandle, TableEnvironment
from .table import GroupedTable, Query, Table

__all__ = ["GroupedTable", "JobHandle", "Query", "Table", "TableEnvironment"]
