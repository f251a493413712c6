"""String functions of the SQL surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*columns: Column) -> Column:
    """CONCAT: null if any argument is null."""
    return F.concat(*columns)
