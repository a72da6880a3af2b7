from . import planning, prep, stats, tables  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
