"""Dense vectors: between long and array form, norms, and numeric utilities over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspace.storage import ship_package

OUT_VALUES = 1 << 22


def densify(features: DataFrame, rows: DataFrame, dim: int, key: str = "node_id") -> DataFrame:
    """(key, vector array<float>): one vector for each row of `rows`, zeros where features(key, idx, val) has nothing.

    The entries of a key are few; they are gathered and scattered into zeros batch by batch, `OUT_VALUES` values at a time, whatever `dim`.
    """
    ship_package(rows.sparkSession)
    entries = features.groupBy(key).agg(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("val").cast("float").alias("val"))).alias("m"))
    joined = rows.select(key).join(entries, key, "left").select(key, F.coalesce("m", F.array().cast("array<struct<idx:bigint,val:float>>")).alias("m"))
    step = max(1, OUT_VALUES // max(dim, 1))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                lists = part.column(1)
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                out = np.zeros((part.num_rows, dim), np.float32)
                out[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[key, "vector"])

    return joined.mapInArrow(scatter, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")


def sparsify(vectors: DataFrame, key: str = "node_id", vector: str = "vector") -> DataFrame:
    """(key, idx, val) of the entries that are not zero."""
    return vectors.select(key, F.posexplode(vector).alias("idx", "val")).where("val <> 0")


def norm(vector: Column) -> Column:
    """Euclidean length of a numeric array."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """The vector at length one; zeros stay zeros."""
    n = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one of them is all zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def all_finite(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def rotary_tables(spark, positions: int, dim: int, theta: float = 10000.0) -> DataFrame:
    """(position, i, cos, sin): angles position / theta^(2i/dim), i < dim/2."""
    angle = F.col("position") / F.pow(F.lit(float(theta)), F.lit(2.0) * F.col("i") / F.lit(float(dim)))
    grid = spark.range(positions).select(F.col("id").cast("int").alias("position"), F.explode(F.sequence(F.lit(0), F.lit(dim // 2 - 1))).alias("i"))
    return grid.select("position", "i", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def last_token_pooled(batch: DataFrame, hidden: str = "hidden", mask: str = "mask") -> DataFrame:
    """Adds `vector`: each row's last hidden state under its mask, at length one. If every row's mask ends with 1 (left padding) the last place is taken, else the place of the last 1."""
    last = F.element_at(F.col(mask), -1)
    left = batch.agg((F.min(last) == 1).alias("left_padded"))
    place = F.when(F.col("left_padded"), F.size(hidden)).otherwise(F.aggregate(F.col(mask), F.lit(0), lambda s, x: s + x.cast("int")))
    return batch.crossJoin(F.broadcast(left)).withColumn("vector", normalised(F.element_at(F.col(hidden), place))).drop("left_padded")
