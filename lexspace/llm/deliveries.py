"""Records that are delivered repeatedly count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.storage import materialise


def first_deliveries(rows: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys..., content): one row for each key, the least by content if its deliveries differ; rows with a null key are left out.

    Only the keys of all rows are shuffled. Those that come repeatedly are written, so that their number is known when the rest is planned: while they are few
    the other rows stay where they are and only the repeated ones are moved.
    """
    own = rows.select(*keys, content).dropna(subset=keys)
    again = materialise(own.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated-keys")
    once = own.join(again, keys, "left_anti")
    first = own.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(content).alias(content))
    return once.unionByName(first)
