"""Occurrences of every distinct term and the records it occurs in, by recursive radix spilling.

Terms are split by the leading bits of their hash: first over the tasks of a shuffle, after each map task
has added up its own counts in bounded rounds; then, within a task, over `fanout` files on disk by the next bits. A file with more than
`rows_in_memory` rows is split again by further bits, until its parts fit; each part is aggregated by DuckDB with
a memory limit, which spills to the same folder if need be. So no task holds more than a part, whatever the number of distinct
terms. Equal terms share all hash bits; a part that can't be split any further (one term) is small after the map
side's sums, and DuckDB aggregates it out of core in any case.

A term counts once for each record in `records` and at each occurrence in `occurrences`; it is marked `rare` if at most
`rare_records` records have it, `common` if more than `common_share` of all records of its field have it (a record without any term is a record too), otherwise the
mark is null; a term that is both counts as rare.

Null keys are left out, repeated deliveries of a key count once (the first by content if they differ), null terms and empty
strings are no terms; null or empty lists leave a record without terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.llm.deliveries import first_deliveries
from lexspace.storage import shared_dir, ship_package

ROWS_IN_MEMORY = 2_000_000
FANOUT_BITS = 4
RARE_RECORDS, COMMON_SHARE = 2, 0.4
MEMORY = "400MB"
MAP_TERMS, MAP_RECORDS = 300_000, 2000
_SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64()), ("bits", pa.uint64())])
COUNTED = "field string, term string, occurrences long, records long"


def distinct_records(records: DataFrame) -> DataFrame:
    """One row of (field, number, words array<string>) for each key."""
    return first_deliveries(records.select("field", F.col("number").cast("long").alias("number"), "words"), ["field", "number"], "words")


def map_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records (field, words): sums for each term, emitted whenever `MAP_TERMS` are held."""
    held: list[pa.Table] = []

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["field", "term"]).aggregate([("occurrences", "sum"), ("records", "sum")]).rename_columns({"occurrences_sum": "occurrences", "records_sum": "records"})

    def emit() -> Iterator[pa.RecordBatch]:
        if held:
            yield from summed(held).select(["field", "term", "occurrences", "records"]).combine_chunks().to_batches()
        held.clear()

    for b in batches:
        for lo in range(0, b.num_rows, MAP_RECORDS):
            words = b.column(1).slice(lo, MAP_RECORDS)
            term, record = pc.list_flatten(words), pc.list_parent_indices(words)
            field = b.column(0).slice(lo, MAP_RECORDS).take(record)
            kept = pa.table({"field": field, "term": term, "record": record}).filter(pc.fill_null(pc.not_equal(term, ""), False))
            once = kept.group_by(["field", "term", "record"]).aggregate([([], "count_all")])
            held.append(once.group_by(["field", "term"]).aggregate([("count_all", "sum"), ("count_all", "count")]).rename_columns({"count_all_sum": "occurrences", "count_all_count": "records"}).select(["field", "term", "occurrences", "records"]))
            if sum(t.num_rows for t in held) >= MAP_TERMS:
                held[:] = [summed(held)]
                if held[0].num_rows >= MAP_TERMS // 2:
                    yield from emit()
    yield from emit()


class RadixSpill:
    """Files of rows by hash bits in a folder, split until each fits and aggregated by DuckDB."""

    def __init__(self, folder: str, rows_in_memory: int, memory: str):
        self.folder, self.most, self.memory = folder, rows_in_memory, memory
        self.made = 0

    def split(self, tables: Iterator[pa.Table], depth: int) -> list[tuple[str, int]]:
        """(file, rows) of each value of the next bits."""
        writers: dict[int, tuple[pq.ParquetWriter, str]] = {}
        rows: Counter = Counter()
        shift, mask = np.uint64(64 - FANOUT_BITS * (depth + 1)), np.uint64((1 << FANOUT_BITS) - 1)
        for t in tables:
            digit = (t.column("bits").to_numpy() >> shift) & mask
            for d in np.unique(digit).tolist():
                if d not in writers:
                    path = f"{self.folder}/{self.made}.parquet"
                    self.made += 1
                    writers[d] = pq.ParquetWriter(path, _SCHEMA, compression="zstd"), path
                part = t.filter(pa.array(digit == d))
                rows[d] += part.num_rows
                writers[d][0].write_table(part)
        for w, _ in writers.values():
            w.close()
        return [(path, rows[d]) for d, (_, path) in sorted(writers.items())]

    def aggregated(self, tables: Iterator[pa.Table], depth: int = 0) -> Iterator[pa.RecordBatch]:
        import duckdb

        for path, rows in self.split(tables, depth):
            if rows > self.most and FANOUT_BITS * (depth + 2) <= 64:
                again = (pa.Table.from_batches([b], _SCHEMA) for b in pq.ParquetFile(path).iter_batches())
                yield from self.aggregated(again, depth + 1)
            else:
                with duckdb.connect(config={"memory_limit": self.memory, "threads": 1, "temp_directory": f"{self.folder}/spill"}) as db:
                    name = path.replace("'", "''")
                    got = db.sql(f"select field, term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from read_parquet('{name}') group by all")
                    yield from got.to_arrow_reader(50_000) if hasattr(got, "to_arrow_reader") else got.fetch_arrow_reader(50_000)
            os.remove(path)


def term_counts(records: DataFrame, rows_in_memory: int = ROWS_IN_MEMORY, memory: str = MEMORY) -> DataFrame:
    """(field, term, occurrences, records) of records (field, words)."""
    spark = records.sparkSession
    ship_package(spark)
    base = shared_dir(spark)
    if not base.startswith(("file:/", "/")):
        raise ValueError(f"the folder in spark.checkpoint.dir must be mounted on all executors, for terms are spilled to it: {base}")
    root = "/" + base.removeprefix("file:").lstrip("/")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(f"{root}/lexspace/radix", exist_ok=True)
        folder = tempfile.mkdtemp(prefix=f"{TaskContext.get().partitionId()}-", dir=f"{root}/lexspace/radix")
        try:
            tables = (pa.Table.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(b.column(4).to_numpy().view(np.uint64))], schema=_SCHEMA) for b in batches if b.num_rows)
            for b in RadixSpill(folder, rows_in_memory, memory).aggregated(tables):
                yield b.cast(pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    mapped = records.select("field", "words").mapInArrow(map_counts, COUNTED).withColumn("radix", F.xxhash64("field", "term"))
    return mapped.repartition("radix").mapInArrow(reduce, COUNTED)


def marked_terms(records: DataFrame, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE, **options) -> DataFrame:
    """(field, term, occurrences, records, mark) of records (field, number, words)."""
    own = distinct_records(records)
    keys = records.select("field", F.col("number").cast("long").alias("number")).where("field is not null and number is not null")
    sizes = keys.groupBy("field").agg(F.count_distinct("number").alias("all"))  # one row for each field
    counted = term_counts(own, **options).join(F.broadcast(sizes), "field")
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.col("all") * common_share, "common")
    return counted.select("field", "term", "occurrences", "records", mark.alias("mark"))
