"""Seeded permutations of the segments within their groups: order(group_id, position, seg_idx)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspace.storage import ship_package


def shuffled_order(segments: DataFrame, seeds: int | list[int]) -> DataFrame:
    """(group_id, seed, position, seg_idx): segments ranked by a hash of group, seed and index; the same in every engine."""
    each = segments.select("group_id", "seg_idx", F.explode(F.array(*[F.lit(s) for s in ([seeds] if isinstance(seeds, int) else seeds)])).alias("seed"))
    h = F.md5(F.concat_ws(":", F.col("group_id").cast("string"), F.col("seed").cast("string"), F.col("seg_idx").cast("string")))
    w = Window.partitionBy("group_id", "seed").orderBy(h, "seg_idx")
    return each.select("group_id", "seed", (F.row_number().over(w) - 1).alias("position"), "seg_idx")


def numpy_order(segments: DataFrame, seed: int) -> DataFrame:
    """(group_id, position, seg_idx): numpy's permutation of the generator seeded by (group, seed); of each group only its size is sent."""
    ship_package(segments.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            orders = [np.random.default_rng((int(g), seed)).permutation(int(n)) for g, n in zip(f["group_id"], f["n"], strict=True)]
            if orders:
                yield pd.DataFrame({"group_id": np.repeat(f["group_id"].to_numpy(), f["n"]), "position": np.concatenate([np.arange(len(o)) for o in orders]), "seg_idx": np.concatenate(orders)})

    return segments.select("group_id", "n").distinct().mapInPandas(run, "group_id long, position int, seg_idx int")
