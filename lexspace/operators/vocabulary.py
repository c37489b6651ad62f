"""Vocabularies: the distinct values of a scope with their places in code-point order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: long enough that no prefix holds a large part of a vocabulary, short enough that the prefixes are far fewer than the values
PREFIX = 4


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(value, idx int, size long): idx is the place among all distinct values, size their number.

    Places are counted within prefixes, and only the prefixes' sizes are added up in one task, one row for each prefix, so no task sorts all values.
    """
    values = tokens.select("value").distinct().withColumn("p", F.substring("value", 1, PREFIX)).where("p is not null")  # as the join below asks: so both uses share one shuffle
    sizes = values.groupBy("p").agg(F.count("*").alias("m"))
    everything = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("p", (F.sum("m").over(Window.orderBy("p")) - F.col("m")).alias("start"), F.sum("m").over(everything).alias("size"))
    placed = values.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("value")))
    return placed.join(starts, "p").select("value", (F.col("start") + F.col("k") - 1).cast("int").alias("idx"), "size")


def dictionary(vocab: DataFrame, weights: DataFrame | None = None, unseen: DataFrame | None = None) -> DataFrame:
    """vocab with w: every value needs a weight. A value without one is an error, unless `unseen` (total) is given: then it weighs like frequency 0."""
    if weights is None:
        return vocab.withColumn("w", F.lit(1.0))
    found = vocab.join(weights.select("value", "w"), "value", "left")
    if unseen is None:
        return found.withColumn("w", F.coalesce("w", F.raise_error(F.concat(F.lit("no weight for the value "), F.col("value"))).cast("double")))
    return found.crossJoin(F.broadcast(unseen)).withColumn("w", F.coalesce("w", F.log(F.col("total") + F.lit(1.0)) + 1)).drop("total")  # unseen is one row


def icf_vector(dictionary_: DataFrame) -> DataFrame:
    """(idx, val): the weight of each vocabulary entry."""
    return dictionary_.select("idx", F.col("w").alias("val"))
