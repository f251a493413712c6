"""A streaming SQL engine on Spark DataFrames and Structured Streaming."""

from .session import session
from .sources.catalog import Catalog, TableSpec

__all__ = ["Catalog", "TableSpec", "session"]
