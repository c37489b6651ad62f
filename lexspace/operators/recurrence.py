"""Recurrence profiles: mean cosine of a group's segments by how far apart they are.

Only pairs that share a value are joined; the number of all pairs of a bin, those with cosine 0 included, is computed from the group's size and
the segment's position, so no pair is made just to be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspace.operators.position import with_position


def lag_bin(lag: Column, n: Column, k: int) -> Column:
    """The bin of k of a lag of 1..n-1, relative to n-1; n >= 2."""
    return F.least(F.floor(lag * k / (n - 1)), F.lit(k - 1))


def pair_lags(segments: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(group_id, i, j, lag double): normalised lags of all pairs of positions i < j of groups of two or more."""
    rows = with_position(segments, order).where("n >= 2").select("group_id", "n", "position")
    other = rows.select("group_id", F.col("position").alias("j"))
    both = rows.join(other, "group_id").where("position < j")
    return both.select("group_id", F.col("position").alias("i"), "j", ((F.col("j") - F.col("position")) / (F.col("n") - 1)).alias("lag"))


def _products(tf: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(group_id, n, i, j, node_i, node_j, x): what each shared value adds to the cosine of two segments i < j."""
    rows = with_position(tf, order).select("group_id", "n", "node_id", "position", "idx", "w")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("node_id")))
    unit = rows.withColumn("norm", norm).where("norm > 0").select("group_id", "n", "node_id", "position", "idx", (F.col("w") / F.col("norm")).alias("u"))
    # a group has one n: joined by, it leaves both sides with the same columns, so they share one shuffle
    other = unit.select("group_id", "n", F.col("node_id").alias("node_j"), F.col("position").alias("j"), "idx", F.col("u").alias("v"))
    both = unit.join(other, ["group_id", "n", "idx"]).where("position < j")
    return both.select("group_id", "n", F.col("position").alias("i"), "j", F.col("node_id").alias("node_i"), "node_j", (F.col("u") * F.col("v")).alias("x"))


def pair_cosines(tf: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(group_id, n, i, j, node_i, node_j, cos) of the pairs of segments i < j that share a value; the others' cosine is 0."""
    return _products(tf, order).groupBy("group_id", "n", "i", "j", "node_i", "node_j").agg(F.sum("x").alias("cos"))


def _bins(k: int) -> tuple[Column, Column, Column]:
    """(bin, least lag, greatest lag) of exploded bins for groups of n."""
    b = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("bin")
    lo = F.greatest(F.ceil(F.col("bin") * (F.col("n") - 1) / k), F.lit(1))
    hi = F.when(F.col("bin") == k - 1, F.col("n") - 1).otherwise(F.ceil((F.col("bin") + 1) * (F.col("n") - 1) / k) - 1)
    return b, lo, hi


def spacing(tf: DataFrame, segments: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """(node_id, idx, val): for each segment and lag bin the mean cosine to all other segments of its group in that bin; bins without any are absent."""
    products = _products(tf, order)  # a sum of cosines needs no pair's own
    ends = F.array(F.col("node_i"), F.col("node_j"))
    sums = products.select(F.explode(ends).alias("node_id"), lag_bin(F.col("j") - F.col("i"), F.col("n"), k).cast("long").alias("bin"), "x").groupBy("node_id", "bin").agg(F.sum("x").alias("s"))
    b, lo, hi = _bins(k)
    rows = with_position(segments, order).where("n >= 2").select("node_id", "n", "position", b).withColumn("lo", lo).withColumn("hi", hi)
    p, n = F.col("position"), F.col("n")
    before, after = F.least("hi", p) - F.col("lo") + 1, F.least(F.col("hi"), n - 1 - p) - F.col("lo") + 1
    counted = rows.select("node_id", F.col("bin").cast("long").alias("bin"), (F.greatest(before, F.lit(0)) + F.greatest(after, F.lit(0))).alias("m")).where("m > 0")
    return counted.join(sums, ["node_id", "bin"], "left").select("node_id", F.col("bin").alias("idx"), (F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("val"))


def group_spacing(tf: DataFrame, segments: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """(group_id, idx, val): the mean cosine of all pairs of the group's segments in each lag bin."""
    sums = _products(tf, order).select("group_id", lag_bin(F.col("j") - F.col("i"), F.col("n"), k).cast("long").alias("bin"), "x").groupBy("group_id", "bin").agg(F.sum("x").alias("s"))
    b, lo, hi = _bins(k)
    rows = segments.where("n >= 2").select("group_id", "n").distinct().select("group_id", "n", b).withColumn("lo", lo).withColumn("hi", hi)
    lags = F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))
    counted = rows.select("group_id", F.col("bin").cast("long").alias("bin"), (lags * F.col("n") - (F.col("lo") + F.col("hi")) * lags / 2).alias("m")).where("m > 0")
    return counted.join(sums, ["group_id", "bin"], "left").select("group_id", F.col("bin").alias("idx"), (F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("val"))
