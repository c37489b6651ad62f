"""Encoders: texts to vectors by an injected callable, once per task, in batches, checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.plans.registry import BY_SLUG
from lexspace.storage import materialise, ship_package

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]

#: The environment variable with the key of each API.
KEY_VARIABLES = {"gemini": "OPENROUTER_API_KEY", "openai": "OPENROUTER_API_KEY", "voyage": "OPENROUTER_API_KEY", "cohere": "COHERE_API_KEY"}


def batch_numbers(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds `batch`: consecutive numbers of batches of `size` rows within each group, in the given order."""
    from pyspark.sql import Window

    w = Window.partitionBy("group_id").orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def group_order(segments: DataFrame) -> DataFrame:
    """(group_id, rank, start, end): the groups in order of group_id, and the place of each one's segments when all are laid end to end.

    Groups are sorted by ranges and added up within each range; one task sees one row for each range only.
    """
    from pyspark.sql import Window

    sizes = segments.groupBy("group_id").agg(F.count("*").alias("n"))
    ranged = materialise(sizes.repartitionByRange("group_id").withColumn("part", F.spark_partition_id()), "group-sizes")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("segments"), F.count("*").alias("groups"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("segments").over(before), F.lit(0)).alias("s"), F.coalesce(F.sum("groups").over(before), F.lit(0)).alias("g"))
    within = Window.partitionBy("part").orderBy("group_id")
    placed = ranged.select("group_id", "part", "n", F.sum("n").over(within).alias("up_to"), F.row_number().over(within).alias("k"))
    end = F.col("s") + F.col("up_to")
    return placed.join(starts, "part").select("group_id", (F.col("g") + F.col("k") - 1).alias("rank"), (end - F.col("n")).alias("start"), end.alias("end"))


def spans(segments: DataFrame) -> DataFrame:
    """(group_id, start, end) of group_order."""
    return group_order(segments).select("group_id", "start", "end")


def encode(segments: DataFrame, factory: Callable[[], Encoder], dim: int | None = None, batch: int = 100, attempts: int = 1, normalise: bool = False) -> DataFrame:
    """(node_id, vector array<float>) of segments (node_id, text).

    factory: makes the encoder, once per task. A batch with values that aren't finite is tried again with a new encoder, `attempts` times in all;
    no vectors, another number of vectors than texts, or another dimension than `dim` is a RuntimeError. A null text is encoded as empty.
    An encoder with `close` is closed when it is dropped or the task ends.
    """
    ship_package(segments.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                texts = ["" if t is None else t for t in part["text"]]
                for left in reversed(range(attempts)):
                    encoder = encoder or factory()
                    got = [np.asarray(v, np.float64) for v in encoder(texts)]
                    if not got:
                        raise RuntimeError("no embeddings returned")
                    if len(got) != len(texts):
                        raise RuntimeError(f"{len(got)} embeddings for {len(texts)} texts")
                    if dim is not None and any(len(v) != dim for v in got):
                        raise RuntimeError(f"embeddings of {len(got[0])} instead of {dim} dimensions")
                    if all(np.isfinite(v).all() for v in got):
                        break
                    _close(encoder)
                    encoder = None
                    if not left:
                        raise RuntimeError(f"embeddings aren't finite after {attempts} attempts")
                if normalise:
                    got = [v / (np.sqrt((v * v).sum()) or 1.0) for v in got]
                yield pd.DataFrame({"node_id": part["node_id"].to_numpy(), "vector": [v.astype(np.float32) for v in got]})
        _close(encoder)

    return segments.select("node_id", "text").mapInPandas(run, "node_id int, vector array<float>")


def _close(encoder: object) -> None:
    if hasattr(encoder, "close"):
        encoder.close()


def api_key(slug: str, env: dict[str, str]) -> str:
    """The key of an API; a missing one is a RuntimeError that names the variable."""
    name = KEY_VARIABLES[slug]
    if not env.get(name):
        raise RuntimeError(f"{name} is not set; {slug} needs it")
    return env[name]


def node_vectors(embeddings: DataFrame, segments: DataFrame) -> DataFrame:
    """(node_id, vector): embeddings (group_id, seg_idx, vector) by node; segments of groups without embeddings are absent."""
    return segments.join(embeddings, ["group_id", "seg_idx"]).select("node_id", "vector")


def model_batch(slug: str) -> int:
    return BY_SLUG[slug].batch or 100
