"""Positional pyramids and position-mean zoning, of segments or of whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(position: Column, n: Column) -> Column:
    """Normalised position of the middle of a segment: (p + 1/2) / n."""
    return (position + F.lit(0.5)) / n


def place_bin(position: Column, n: Column, k: int) -> Column:
    """The segment's bin of k: floor(place * k), in whole numbers; the end belongs to the last bin."""
    return F.least(F.floor((2 * position + 1) * k / (2 * n)), F.lit(k - 1))


def with_position(rows: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Adds `position`: the segment's own index, or that of order(group_id, position, seg_idx), which holds every segment."""
    if order is None:
        return rows.withColumn("position", F.col("seg_idx"))
    return rows.join(order.select("group_id", "seg_idx", "position"), ["group_id", "seg_idx"])


def to_segments(by_group: DataFrame, segments: DataFrame) -> DataFrame:
    """A group's vector (group_id, idx, val) for each of its segments."""
    return segments.select("group_id", "node_id").join(by_group, "group_id").select("node_id", "idx", "val")


def pyramid(tf: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """(group_id, node_id, idx, val): a segment's weights in the block of its bin."""
    rows = with_position(tf, order)
    idx = place_bin(F.col("position"), F.col("n"), k).cast("long") * F.col("size") + F.col("idx")
    return rows.select("group_id", "node_id", idx.cast("long").alias("idx"), F.col("w").alias("val"))


def group_pyramid(tf: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """(group_id, idx, val): the sum of the pyramids of the group's segments."""
    return pyramid(tf, k, order).groupBy("group_id", "idx").agg(F.sum("val").alias("val"))


def _halves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (idx, w, m) as two: w at idx, m at size + idx."""
    both = F.array(F.struct(F.col("idx").cast("long").alias("idx"), F.col("w").alias("val")), F.struct((F.col("size") + F.col("idx")).cast("long").alias("idx"), (F.col("m") + F.lit(0.0)).alias("val")))
    return rows.select(*keys, F.explode(both).alias("x")).select(*keys, "x.idx", "x.val")


def zoning(tf: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(node_id, idx, val): weight of each present value, then weight * (2t - 1) of the segment's place t."""
    rows = with_position(tf, order)
    return _halves(rows.withColumn("m", F.col("w") * (2 * place(F.col("position"), F.col("n")) - 1)), ["node_id"])


def group_zoning(tf: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(group_id, idx, val): as zoning, with the mean place of the group's segments that have the value."""
    rows = with_position(tf, order).withColumn("t", place(F.col("position"), F.col("n")))
    by = rows.groupBy("group_id", "idx", "size", "w").agg(F.avg("t").alias("t"))
    return _halves(by.withColumn("m", F.col("w") * (2 * F.col("t") - 1)), ["group_id"])
