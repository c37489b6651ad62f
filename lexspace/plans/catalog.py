"""The dataset catalog: Hive-style leaves of (node_id int, vector array<float>), written once.

A leaf counts as written when it has a success marker, so an interrupted write is done again. Description and version stand in a
sidecar file of the leaf. Partition columns differ between subtrees, so the reader goes leaf by leaf. All files are reached through Hadoop's
file systems, so a root may lie in any storage that Spark reads.

Vectors that come as they are go to `write_dataset`; those that are nearly all zeros are written from their entries by `write_entries`, into files of the same schema (see `functions.runs`).
"""

from __future__ import annotations

import json
import math
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexspace.functions import runs
from lexspace.storage import delete, exists, file_system, ship_package, write_text

VERSION = "1.0"
SIDECAR = "_dataset.json"
FILE_BYTES = 256 << 20


def lexical_path(root: str, unit: str, construction: str, text: str | None = None) -> str:
    return "/".join([root.rstrip("/"), "type=lexical", f"unit={unit}", *([f"text={text}"] if text else []), f"construction={construction}"])


def semantic_path(root: str, model: str, variation: str) -> str:
    return f"{root.rstrip('/')}/type=semantic/model={model}/text={variation}"


def is_written(leaf: str, spark: SparkSession | None = None) -> bool:
    return exists(spark or SparkSession.builder.getOrCreate(), f"{leaf}/_SUCCESS")


def files_of(rows: int, dim: int) -> int:
    """The files a dataset is written to: one, or as many as keep each within about `FILE_BYTES` of values."""
    return max(1, math.ceil(rows * dim * 4 / FILE_BYTES))


def write_dataset(vectors: DataFrame, leaf: str, description: str, files: int = 1) -> str:
    """Write (node_id, vector) to a leaf: sorted by node_id, zstd. No rows, or vectors of different length, are an error, and the leaf is removed.

    The checks are counted while the rows are written, so the vectors are made once and never held.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("node_id").cast("int").alias("node_id"), F.col("vector").cast("array<float>").alias("vector"))
    ordered = own.coalesce(1) if files == 1 else own.repartitionByRange(files, "node_id")
    seen = Observation()
    checked = ordered.sortWithinPartitions("node_id").observe(seen, F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"), F.count(F.lit(1)).alias("n"))
    checked.write.mode("overwrite").option("compression", "zstd").parquet(leaf)
    r = seen.get
    if not r["n"]:
        delete(spark, leaf)
        raise IndexError(f"no vectors for {leaf}")
    if r["lo"] != r["hi"]:
        delete(spark, leaf)
        raise ValueError(f"vectors of {r['lo']} to {r['hi']} entries for {leaf}")
    write_text(spark, f"{leaf}/{SIDECAR}", json.dumps({"description": description, "version": VERSION, "dimension": r["lo"], "rows": r["n"]}))
    return leaf


def _encoded(dim: int) -> Callable:
    """Arrow function: of one part's rows (idx -1: a row of this node, with the entries of its key) and entries (key, idx, val) the files, in order of node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (given := [b for b in batches if b.num_rows]):
            return
        key, node, idx, val = (c.to_numpy() for c in pa.Table.from_batches(given).select(["key", "node_id", "idx", "val"]).columns)
        row = idx < 0
        nodes, owner = node[row], key[row]
        order = np.argsort(nodes, kind="stable")
        nodes, owner = nodes[order], owner[order]
        key, idx, val = key[~row], idx[~row], val[~row]
        if len(idx) and idx.max() >= dim:
            raise IndexError(f"an entry at {idx.max()} of vectors of {dim}")
        order = np.lexsort((idx, key))
        key, idx, val = key[order], idx[order], val[order]
        some = val != 0
        some[:-1] &= (key[1:] != key[:-1]) | (idx[1:] != idx[:-1])
        key, idx, val = key[some], idx[some], val[some]
        start = np.searchsorted(key, owner)
        for content, n in runs.files(nodes, start, np.searchsorted(key, owner, "right") - start, idx, val, dim):
            yield pa.RecordBatch.from_arrays([pa.array([content.removesuffix(runs.MAGIC)], pa.binary()), pa.array([n], pa.int64())], names=["file", "n"])

    return run


def write_entries(features: DataFrame, rows: DataFrame, dim: int, leaf: str, description: str, bounds: list[float], parts: int) -> str:
    """Write the vectors of `rows` (group_id, node_id) to a leaf as `write_dataset` does, made of the entries features(node_id or group_id, idx, val), dim at least 1. Entries of a group are those of each of its rows.

    Zeros are neither made nor moved: each part gets its rows and their entries once, a group's entries once for all its rows there. bounds: ascending node ids between at most `parts` parts, used if entries are a group's.
    A file is one record of Spark's text files, whose line separator is Parquet's closing mark, so it is committed as any other output and on any file system.
    """
    spark = rows.sparkSession
    ship_package(spark)
    entry = (F.col("idx").cast("long").alias("idx"), F.col("val").cast("float").alias("val"))
    none = (F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("float").alias("val"))
    if "node_id" in features.columns:
        key = F.col("node_id").cast("long").alias("key")
        placed = rows.select(key, F.col("node_id").cast("int"), *none).unionByName(features.select(key, F.lit(0).alias("node_id"), *entry)).repartitionByRange(parts, "key")
    else:
        edges = np.asarray(bounds)
        part = F.pandas_udf(lambda node: pd.Series(np.searchsorted(edges, node.to_numpy(), "right").astype(np.int32)), "int")
        own = rows.select(F.col("group_id").cast("long").alias("key"), F.col("node_id").cast("int"), part(F.col("node_id")).alias("part"))
        entries = features.select(F.col("group_id").cast("long").alias("key"), *entry).join(own.select("key", "part").distinct(), "key")
        placed = own.select("part", "key", "node_id", *none).unionByName(entries.select("part", "key", F.lit(0).alias("node_id"), *entry)).repartitionById(parts, "part")
    seen = Observation()
    made = placed.select("key", "node_id", "idx", "val").mapInArrow(_encoded(dim), "file binary, n long").observe(seen, F.sum("n").alias("n"))
    options = {"lineSep": runs.MAGIC.decode(), "maxRecordsPerFile": 1, "compression": "none", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    made.select(F.col("file").cast("string").alias("value")).write.mode("overwrite").options(**options).text(leaf)
    n = seen.get["n"]
    if not n:
        delete(spark, leaf)
        raise IndexError(f"no vectors for {leaf}")
    own, fs = file_system(spark, leaf)
    for status in fs.listStatus(own):
        path = status.getPath()
        if path.getName().endswith(".txt"):
            if not status.getLen():
                fs.delete(path, False)  # of a part without rows
            else:
                fs.rename(path, path.suffix(".parquet"))
    write_text(spark, f"{leaf}/{SIDECAR}", json.dumps({"description": description, "version": VERSION, "dimension": dim, "rows": n}))
    write_text(spark, f"{leaf}/_SUCCESS", "")
    return leaf


def leaves(root: str, spark: SparkSession | None = None) -> list[tuple[dict[str, str], str]]:
    """(partition values, path) of all written leaves, in order of path."""
    spark = spark or SparkSession.builder.getOrCreate()
    found = []
    for depth in ("type=*/*=*/*=*", "type=*/*=*/*=*/*=*"):
        own, fs = file_system(spark, f"{root.rstrip('/')}/{depth}/_SUCCESS")
        for status in fs.globStatus(own) or []:
            leaf = status.getPath().getParent().toString()
            found.append((dict(re.findall(r"(\w+)=([^/]+)", leaf[leaf.index("/type=") :])), leaf))
    return sorted(found, key=lambda x: x[1])


def read_datasets(spark: SparkSession, root: str, **wanted: str) -> DataFrame | None:
    """(type, unit, model, text, construction, node_id, vector) of the leaves with these partition values; None if there are none."""
    out = None
    for values, path in leaves(root, spark):
        if any(values.get(k) != v for k, v in wanted.items()):
            continue
        one = spark.read.parquet(path).select(*[F.lit(values.get(k)).cast("string").alias(k) for k in ("type", "unit", "model", "text", "construction")], "node_id", "vector")
        out = one if out is None else out.unionByName(one)
    return out


def read_entries(spark: SparkSession, root: str, label: Callable[[dict[str, str]], str], **wanted: str) -> DataFrame | None:
    """(dataset, node_id, idx, val): the entries other than 0 of the leaves with these partition values, dataset being the label of a leaf's; None if there are no leaves.

    Files made of entries are read as such, so stretches of zeros cost nothing; each is read whole, in one task.
    """
    chosen = [(values, path) for values, path in leaves(root, spark) if all(values.get(k) == v for k, v in wanted.items())]
    if not chosen:
        return None
    ship_package(spark)
    place = {path[path.index("/type=") :]: k for k, (_, path) in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                k = place[path[path.index("/type=") :].rpartition("/")[0]]
                for node, idx, val in runs.entries(content.as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), k, np.int32)), pa.array(node.astype(np.int32)), pa.array(idx.astype(np.int64)), pa.array(val)], names=["k", "node_id", "idx", "val"])

    files = spark.read.format("binaryFile").load([path for _, path in chosen]).select("path", "content")
    names = F.array(*[F.lit(label(values)) for values, _ in chosen])
    return files.mapInArrow(run, "k int, node_id int, idx long, val float").select(F.element_at(names, F.col("k") + 1).alias("dataset"), "node_id", "idx", "val")


def not_written(plan: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a plan whose dataset isn't written yet."""
    return plan.join(written, keys, "left_anti")


def new_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """The distinct rows of a later listing that an earlier one hasn't."""
    return after.subtract(before)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(leaf): the written leaves, relative to the root."""
    paths = [(leaf[leaf.index("/type=") + 1 :],) for _, leaf in leaves(root, spark)]
    return spark.createDataFrame(paths, "leaf string")


def archive(spark: SparkSession, root: str, chosen: DataFrame, target: str) -> list[str]:
    """Zip the files of the chosen leaves (leaf) into a local file with their relative names; returns the names. A listing is as long as the catalog, not as its data."""
    names = []
    with zipfile.ZipFile(target, "w") as z:
        for leaf in sorted(r.leaf for r in chosen.collect()):
            own, fs = file_system(spark, f"{root.rstrip('/')}/{leaf}")
            for status in fs.listStatus(own):
                name = f"{leaf}/{status.getPath().getName()}"
                stream = fs.open(status.getPath())
                with z.open(name, "w", force_zip64=True) as out:
                    while len(part := stream.readNBytes(1 << 20)):
                        out.write(bytes(part))
                stream.close()
                names.append(name)
    return names
