"""A join side that is broadcast only when it is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each: some tens of megabytes.
BROADCAST_ROWS = 500_000


def sized(written: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``written`` (a table that is on disk) with a broadcast hint if it has ``most`` rows or fewer.

    Beyond that Spark joins by shuffle; the rows that come out are the same.
    """
    return F.broadcast(written) if written.count() <= most else written
