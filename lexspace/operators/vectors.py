"""Bag-of-words vectors of segments in long form (node_id, idx, val); absent entries are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequency(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(group_id, n, seg_idx, node_id, idx, size, w, tf); words out of the dictionary are left out. Counts are added up before the join."""
    counted = tokens.groupBy("group_id", "n", "seg_idx", "node_id", "value").agg(F.count("*").alias("tf"))
    return counted.join(dictionary, "value").drop("value")


def _long(tf: DataFrame, val) -> DataFrame:
    return tf.select("node_id", F.col("idx").cast("long").alias("idx"), val.cast("double").alias("val"))


def count(tf: DataFrame) -> DataFrame:
    return _long(tf, F.col("tf"))


def binary(tf: DataFrame) -> DataFrame:
    return _long(tf, F.lit(1.0))


def log_count(tf: DataFrame) -> DataFrame:
    return _long(tf, F.log1p("tf"))


def icf(tf: DataFrame) -> DataFrame:
    return _long(tf, F.col("w"))


def tf_icf(tf: DataFrame) -> DataFrame:
    return _long(tf, F.log1p("tf") * F.col("w"))
