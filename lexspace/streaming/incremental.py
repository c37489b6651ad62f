"""Vectors of newly delivered groups, written as they arrive.

A stream of nested groups (a folder of Parquet files that grows) is turned into long-form vectors over a fixed dictionary. Each micro-batch
writes its own folder by number, and overwrites it if it is run again after a failure, so every delivery is written exactly once. A group that is delivered again
in a later batch is read once (its first batch) by `read_incremental`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexspace.operators import vectors
from lexspace.sources.corpus import tokens

VALUES = {"binary": vectors.binary, "count": vectors.count, "log_count": vectors.log_count, "icf": vectors.icf, "tf_icf": vectors.tf_icf}


def stream_vectors(spark: SparkSession, source: str, schema: StructType, unit: str, construction: str, dictionary: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start writing (group_id, node_id, idx, val) of new groups below `target`; with `once` the query ends when all files there now are done."""
    make = VALUES[construction]

    def write(batch: DataFrame, number: int) -> None:
        tf = vectors.term_frequency(tokens(batch, unit), dictionary)
        groups = tf.select("node_id", "group_id").distinct()
        make(tf).join(groups, "node_id").select("group_id", "node_id", "idx", "val").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_incremental(spark: SparkSession, target: str) -> DataFrame:
    """(node_id, idx, val) of all batches; of a group delivered in several batches the first counts."""
    rows = spark.read.parquet(target)
    first = rows.groupBy("group_id").agg(F.min("batch").alias("batch"))
    return rows.join(first, ["group_id", "batch"]).select("node_id", "idx", "val")
