"""Items that appear together, and how much more often than chance: a blocked Gram matrix.

Blocks of at most `block_baskets` baskets become sparse binary matrices, their columns (items) in blocks of `BLOCK_ITEMS`. In each map task the product
of the transposed matrix with itself is made for one pair of column blocks after the other: the pairs of columns that meet in a row, and the diagonal, added up over
the blocks of the task. Only these sums leave the task; they are summed by a shuffle on the pair and written. The diagonal holds the marginals, so the baskets are
read once; the counts are normalised by the expected marginals:
    lift = n * H / (n_a * n_b), H = baskets with any item.

An item that most baskets have is one column like others: its sums are spread over its partners, in one row for each pair and record block. A basket of very many
items is added up in parts, so memory holds one block pair's cells.

Within a basket each item counts once; null items and baskets are left out, an empty basket counts nowhere. The empty string is an item like others. An empty table gives no rows;
a pair is given once, the smaller item first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.storage import materialise, ship_package

BLOCK_BASKETS = 20_000
BLOCK_ITEMS = 4096
HELD_CELLS = 2_000_000


def item_baskets(baskets: DataFrame) -> DataFrame:
    """(items array<string>): the distinct items of each basket with any."""
    clean = F.array_distinct(F.filter(F.col("items"), lambda x: x.isNotNull()))
    return baskets.select(clean.alias("items")).where(F.size("items") > 0)


def gram(code: np.ndarray, owner: np.ndarray, width: int = BLOCK_ITEMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """X'X of a block of sparse rows, upper triangle, one block pair of columns after the other: column codes and counts.

    code and owner are sorted by owner, then code.
    """
    blocks = code // width
    last = int(blocks.max()) + 1 if len(code) else 0
    for i in range(last):
        for j in range(i, last):
            own = np.flatnonzero((blocks == i) | (blocks == j)) if last > 1 else np.arange(len(code))
            c, o, k = code[own], owner[own], blocks[own]
            cells, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            held: list[np.ndarray] = []
            at, step, n_held = np.arange(len(c)), 1, 0
            while len(at):
                at = at[at + step < len(c)]
                at = at[o[at] == o[at + step]]
                met = at[(k[at] == i) & (k[at + step] == j)] if last > 1 else at
                held.append(c[met].astype(np.int64) * (1 << 31) + c[met + step])
                n_held += len(met)
                step += 1
                if n_held > 2_000_000 or not len(at):  # very long baskets are added up as they come
                    new, n = np.unique(np.concatenate(held), return_counts=True)
                    cells, where = np.unique(np.concatenate([cells, new]), return_inverse=True)
                    sums = np.bincount(where, np.concatenate([sums, n]), len(cells)).astype(np.int64)
                    held, n_held = [], 0
            yield cells >> 31, cells & ((1 << 31) - 1), sums


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["item_a", "item_b"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["item_a", "item_b", "n"])


def products(batches: Iterator[pa.RecordBatch], block_baskets: int = BLOCK_BASKETS) -> Iterator[pa.RecordBatch]:
    """Of baskets (items): the cells of X'X with the diagonal, added up over the task's blocks in bounded rounds, and the number of baskets as the cell of nulls."""
    total, held, rows = 0, [], 0
    for b in batches:
        for lo in range(0, b.num_rows, block_baskets):
            column = b.column(0).slice(lo, block_baskets)
            lengths = np.diff(column.offsets.to_numpy())
            total += len(lengths)
            words = column.flatten().dictionary_encode()
            if not len(words):
                continue
            names = np.array(words.dictionary.to_pylist(), object)
            order = np.argsort(names)
            rank = np.argsort(order)
            code, owner = rank[words.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(lengths)), lengths)
            names, order = pa.array(names[order], pa.string()), np.lexsort((code, owner))
            own = np.arange(len(names))
            for x, y, n in ((own, own, np.bincount(code, minlength=len(names))), *gram(code[order], owner[order])):
                held.append(pa.table({"item_a": names.take(pa.array(x)), "item_b": names.take(pa.array(y)), "n": pa.array(n, pa.int64())}))
                rows += len(n)
                if rows >= HELD_CELLS:
                    held = [_summed(held)]
                    rows = held[0].num_rows
                    if rows >= HELD_CELLS // 2:
                        yield from held[0].combine_chunks().to_batches()
                        held, rows = [], 0
    if held:
        yield from _summed(held).combine_chunks().to_batches()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([total], pa.int64())], names=["item_a", "item_b", "n"])


def together(baskets: DataFrame, least: int = 1, block_baskets: int = BLOCK_BASKETS) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, baskets, lift) of all pairs of baskets (items array<string>) that occur together at least `least` times."""
    spark = baskets.sparkSession
    ship_package(spark)
    cells = item_baskets(baskets).mapInArrow(lambda b: products(b, block_baskets), "item_a string, item_b string, n long").groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))
    cells = materialise(cells.where((F.col("n") >= least) | F.col("item_a").isNull() | (F.col("item_a") == F.col("item_b"))), "p7-cells")
    total = cells.where("item_a is null").select(F.col("n").alias("baskets"))  # one row
    a, b = (cells.where("item_a = item_b").select(F.col("item_a").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = cells.where("item_a < item_b").join(a, "item_a").join(b, "item_b").crossJoin(F.broadcast(total))
    return both.select("item_a", "item_b", "n", "n_a", "n_b", "baskets", (F.col("n") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))).alias("lift"))
