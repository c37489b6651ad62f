"""Most similar vectors by collision counting over single projections.

Index. Every usable vector (all finite, not all zero, of the common length) is put on the unit sphere and projected on random directions. Blocks of
`BLOCK_ROWS` rows are written once to the shared folder: their vectors and, for each projection, the rows sorted by it.

Windows. The rows whose projection lies within the search radius of a query's own collide with it there: a window of the sorted array, found by
binary search. Enlarging the radius ("virtual rehashing") expands the same windows. Rows that collide in at least the level's threshold of
projections are verified by their cosine. A query ends at the first radius that covers its k-th best verified neighbour; for the others the
windows are expanded to the next level's radius, or just to the distance of the k-th best if that is less. So each query's windows are as wide as its
own neighbours are far, and no wider.

For a row at the radius the number of collisions is binomial with p = 0.683: of 32 projections fewer than 14 in 0.3 %, of 64 fewer than 33 in
0.2 %, and fewer the nearer the row is; the last level's 35 miss 0.7 % at its radius and keep a third of the rows at right angles from being verified. A query with no neighbours within the last radius gets the best
of all rows that collide there; one with fewer than k such rows is compared with the rest of the collection at the end, so only a
collection of fewer than k other vectors gives fewer than k neighbours.

Queries are sent to the tasks in passes of at most `queries_per_pass`, whatever their number; each task keeps its own k best keys of each query, so no row of
the collection is shuffled. What is found stays in written tables; the driver sees the open queries of a pass only.

Rows with a null key or an unusable vector are no neighbours and no queries; keys written repeatedly count once (the vector that is nearest counts; of a
query the first by value); ties at the k-th place go to the smaller key; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspace.storage import discard, materialise, ship_package

#: (radius, projections, threshold) of each level.
LEVELS = ((0.2, 32, 14), (0.32, 32, 14), (0.65, 64, 33), (0.85, 64, 33), (1.1, 64, 35))
QUERIES_PER_PASS = 8192
BLOCK_ROWS = 8192  #: places of rows must fit 16 bits, numbers of projections 8
SEED = 5
_INDEX = "keys binary, vectors binary, placed binary, line binary"


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key long, vector array<float>) of the rows whose vector has `dim` finite values, not all zero."""
    v = F.col(vector)
    return vectors.select(F.col(key).cast("long").alias("key"), v.cast("array<float>").alias("vector")).where(
        F.col("key").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    )


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of usable vectors as rows of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((projections, dim)).astype(np.float32).T


def sorted_projections(rows: DataFrame, dim: int, projections: int) -> DataFrame:
    """The index: of each block its keys, unit vectors, and for each projection the sorted values (half precision) with the rows they are of."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directions(dim, projections)
        for keys, x in _blocks(batches, dim):
            projected = (x @ d).T.astype(np.float16)
            placed = projected.argsort(axis=1, kind="stable")
            line = np.take_along_axis(projected, placed, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (keys.astype(np.int64), x, placed.astype(np.uint16), line)], names=["keys", "vectors", "placed", "line"])

    # row groups of a few blocks: a reader holds no more at once
    return materialise(rows.mapInArrow(build, _INDEX), "p5-index", **{"parquet.block.size": 32 << 20})


class Queries:
    """Open query vectors with the radius of each, ready to be counted against blocks."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, radius: np.ndarray, bound: np.ndarray, k: int, level: tuple[float, int, int], dim: int, projections: int):
        self.keys, self.vectors, self.bound, self.k = keys, vectors, bound, k
        self.projections, self.threshold = level[1], level[2]
        projected = (vectors @ directions(dim, projections))[:, : self.projections]
        self.lo, self.hi = (projected - radius[:, None]).T.copy(), (projected + radius[:, None]).T.copy()

    def in_block(self, keys: np.ndarray, rows: np.ndarray, placed: np.ndarray, line: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, key, cosine) of each query's k best different keys among the rows that collide with it often enough and reach its bound."""
        m, n = self.projections, len(keys)
        # a row collides if its place in a sorted array lies within the query's window there
        places = np.empty((m, n), np.uint16)
        np.put_along_axis(places, placed[:m].astype(np.int64), np.broadcast_to(np.arange(n, dtype=np.uint16), (m, n)), axis=1)
        lines = line[:m].astype(np.float32)
        lo = np.stack([np.searchsorted(a, q) for a, q in zip(lines, self.lo, strict=True)], axis=1)
        hi = np.stack([np.searchsorted(a, q, side="right") for a, q in zip(lines, self.hi, strict=True)], axis=1)
        lo, width = lo.astype(np.uint16)[:, :, None], (hi - lo).astype(np.uint16)[:, :, None]
        past, within, count = np.empty((m, n), np.uint16), np.empty((m, n), bool), np.empty(n, np.uint8)
        got, number, at, held = [], [], [], 0
        for q in range(len(self.keys)):
            np.subtract(places, lo[q], out=past)  # places before the window wrap around to large numbers
            np.less(past, width[q], out=within)
            np.add.reduce(within.view(np.uint8), axis=0, dtype=np.uint8, out=count)
            near = np.flatnonzero(count >= self.threshold)
            if len(near):
                number.append(np.full(len(near), q))
                at.append(near)
                held += len(near)
            if held > 500_000:
                got.append(self._verified(np.concatenate(number), np.concatenate(at), keys, rows, bound))
                number, at, held = [], [], 0
        if number:
            got.append(self._verified(np.concatenate(number), np.concatenate(at), keys, rows, bound))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    def _verified(self, number: np.ndarray, at: np.ndarray, keys: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cosine = np.empty(len(at), np.float32)
        for s in range(0, len(at), 1 << 16):
            part = slice(s, s + (1 << 16))
            cosine[part] = np.einsum("ij,ij->i", self.vectors[number[part]], rows[at[part]])
        near = cosine >= bound[number]
        return self.best(number[near], keys[at[near]], cosine[near])

    def best(self, number: np.ndarray, keys: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = keys != self.keys[number]
        number, keys, cosine = number[keep], keys[keep], cosine[keep]
        o = np.lexsort((-cosine, keys, number))
        number, keys, cosine = number[o], keys[o], cosine[o]
        first = np.r_[True, (number[1:] != number[:-1]) | (keys[1:] != keys[:-1])] if len(o) else np.zeros(0, bool)
        number, keys, cosine = number[first], keys[first], cosine[first]
        o = np.lexsort((keys, -cosine, number))
        number, keys, cosine = number[o], keys[o], cosine[o]
        start = np.searchsorted(number, number)
        top = np.arange(len(number)) - start < self.k
        return number[top], keys[top], cosine[top]


class Best:
    """The k best keys of each query among the blocks of a task so far."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        #: the cosine of the k-th best key known; less than any cosine while there are fewer
        self.bound = queries.bound.copy()

    def add(self, *found: np.ndarray) -> None:
        if not len(found[0]):
            return
        number, keys, cosine = self.queries.best(*(np.concatenate(x) for x in zip(self.rows, found, strict=True)))
        self.rows = number, keys, cosine
        last = np.searchsorted(number, np.arange(len(self.bound)), side="right") - 1
        full = np.bincount(number, minlength=len(self.bound)) == self.queries.k
        self.bound[full] = np.maximum(self.bound[full], cosine[last[full]])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "node_id",
    vector: str = "vector",
    k: int = 5,
    dim: int = 64,
    levels: tuple[tuple[float, int, int], ...] = LEVELS,
    queries_per_pass: int = QUERIES_PER_PASS,
) -> DataFrame:
    """(query long, neighbour long, cosine float, rank int): the k most similar keys of each key in `queries`, a column of keys."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, key, vector, dim)
    projections = max(m for _, m, _ in levels)
    index = sorted_projections(rows, dim, projections)
    keys = queries.select(F.col(queries.columns[0]).cast("long").alias("key")).where("key is not null").distinct()
    asked = materialise(rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("vector").alias("vector")), "p5-queries")
    n = asked.count()
    passes = max(1, math.ceil(n / queries_per_pass * 1.1)) if n > queries_per_pass else 1
    found = None
    for p in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == p)
        part = _one_pass(index, some, k, dim, projections, levels)
        found = part if found is None else found.unionByName(part)
    for done in (index, asked):  # what was found is written
        discard(done)
    return found


_FOUND = "query long, neighbour long, cosine float"


def _one_pass(index: DataFrame, asked: DataFrame, k: int, dim: int, projections: int, levels: tuple[tuple[float, int, int], ...]) -> DataFrame:
    """The k best of some queries: a round over the index for each level, of the queries that are still open."""
    spark = index.sparkSession
    best, open_ = None, asked.withColumn("n", F.lit(0)).withColumn("kth", F.lit(-2.0).cast("float"))
    done = 0.0
    for level in (*levels, (math.inf, 1, 1)):
        got = open_.toArrow()  # the open queries of one pass
        if not got.num_rows:
            break
        kth = got.column("kth").to_numpy()
        reach = np.where(kth < -1.5, np.inf, np.sqrt(np.maximum(2 - 2 * kth.astype(np.float64), 0)) + 1e-4)
        radius = np.maximum(np.minimum(level[0], reach), 1e-4)
        x = unit_rows(got.column("vector").combine_chunks(), dim)
        block = spark.sparkContext.broadcast(Queries(got.column("key").to_numpy(), x, radius, kth, k, level, dim, projections))

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            q = block.value
            found = Best(q)
            for b in batches:
                for i in range(b.num_rows):
                    own = np.frombuffer(b.column(0)[i].as_buffer(), np.int64)
                    rows = np.frombuffer(b.column(1)[i].as_buffer(), np.float32).reshape(len(own), dim)
                    placed = np.frombuffer(b.column(2)[i].as_buffer(), np.uint16).reshape(projections, len(own))
                    line = np.frombuffer(b.column(3)[i].as_buffer(), np.float16).reshape(projections, len(own))
                    found.add(*q.in_block(own, rows, placed, line, found.bound))
            number, other, cosine = found.rows
            yield pa.RecordBatch.from_arrays([pa.array(q.keys[number]), pa.array(other), pa.array(cosine)], names=["query", "neighbour", "cosine"])

        new = index.mapInArrow(count, _FOUND)
        before, best = best, materialise(_k_best(new if best is None else best.select("query", "neighbour", "cosine").unionByName(new), k), "p5-best")
        block.unpersist()
        if before is not None:
            discard(before)
        done = level[0]
        state = best.groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("kth"))
        # open: fewer than k yet, or the k-th best lies beyond the windows of this level; beyond the last level it need not be covered
        ends = (F.col("n") >= k) & ((F.col("kth") >= 1 - done * done / 2) | F.lit(done >= levels[-1][0]))
        open_ = asked.join(state.withColumnRenamed("query", "key"), "key", "left").where(~F.coalesce(ends, F.lit(False)))
        open_ = open_.select("key", "vector", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(-2.0)).cast("float").alias("kth"))
    return best if best is not None else spark.createDataFrame([], _FOUND + ", rank int")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys, rows, n = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        keys.append(b.column(0).to_numpy(zero_copy_only=False))
        rows.append(unit_rows(b.column(1), dim))
        n += b.num_rows
        while n >= BLOCK_ROWS:
            k, x = np.concatenate(keys), np.concatenate(rows)
            yield k[:BLOCK_ROWS], x[:BLOCK_ROWS]
            keys, rows, n = [k[BLOCK_ROWS:]], [x[BLOCK_ROWS:]], n - BLOCK_ROWS
    if n:
        yield np.concatenate(keys), np.concatenate(rows)


def _k_best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest different neighbours of each query; ties by key. Each task drops what can't be among them before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    best = found.groupBy("query", "neighbour").agg(F.max("cosine").alias("cosine"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
