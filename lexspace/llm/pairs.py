"""Pairs within groups whose size isn't bounded: no task sees more than two parts of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 4096


def pairs_within(rows: DataFrame, group: list[str], item: str, a: str, b: str, part: int = PART) -> DataFrame:
    """(group..., a, b) of all pairs a < b of the distinct items of each group.

    Each group is cut into parts of about `part` items by a hash, and each pair of parts is a cell of its own, joined by its key.
    Rows with a null group or item are left out.
    """
    own = rows.select(*group, item).dropna().distinct()
    sizes = own.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(part)).cast("int")
    placed = own.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64(F.col(item), F.lit(1)), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = placed.withColumn("_i", F.least("_part", "_other")).withColumn("_j", F.greatest("_part", "_other"))
    left, right = (cells.select(*group, "_i", "_j", F.col("_part").alias(f"_part_{x}"), F.col(item).alias(x)) for x in (a, b))
    both = left.join(right, [*group, "_i", "_j"]).where((F.col(a) < F.col(b)) & ((F.col("_i") == F.col("_j")) | (F.col(f"_part_{a}") != F.col(f"_part_{b}"))))
    return both.select(*group, a, b)
