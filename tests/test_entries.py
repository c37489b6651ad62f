"""Datasets written from their entries: what any reader finds in them, and what they cost."""

import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexspace.functions import runs
from lexspace.plans import catalog


def encoded(dense, nodes):
    r, i = np.nonzero(dense)
    lengths = np.bincount(r, minlength=len(dense))
    return list(runs.files(nodes, np.cumsum(lengths) - lengths, lengths, i, dense[r, i], dense.shape[1]))


@pytest.mark.parametrize("rows,dim,share", [(50, 1000, 0.01), (7, 1, 0.5), (300, 4, 0.9), (5, 10, 0.0), (3, 70000, 0.001)])
def test_every_reader_finds_the_vectors(spark, tmp_path, monkeypatch, rows, dim, share):
    import duckdb

    monkeypatch.setattr(runs, "GROUP_ENTRIES", 60)
    rng = np.random.default_rng(dim)
    dense, nodes = np.where(rng.random((rows, dim)) < share, rng.normal(size=(rows, dim)), 0).astype(np.float32), np.arange(rows) * 3 - 5
    (content, n), = encoded(dense, nodes)
    path = f"{tmp_path}/one.parquet"
    (tmp_path / "one.parquet").write_bytes(content)
    df = spark.read.parquet(path)
    assert n == rows and df.dtypes == [("node_id", "int"), ("vector", "array<float>")]
    for got in (pq.read_table(path).to_pylist(), [r.asDict() for r in df.collect()], duckdb.sql(f"select * from '{path}'").to_arrow_table().to_pylist()):
        assert [r["node_id"] for r in got] == nodes.tolist() and (np.array([r["vector"] for r in got], np.float32) == dense).all()
    assert df.where("node_id = -2").count() == 1
    pq.write_table(pq.read_table(path), f"{tmp_path}/other.parquet")
    for name in ("one", "other"):
        own = np.zeros_like(dense)
        for node, idx, val in runs.entries((tmp_path / f"{name}.parquet").read_bytes()):
            own[(node + 5) // 3, idx] = val
        assert (own == dense).all()


def test_files_and_row_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(runs, "GROUP_VALUES", 40)
    monkeypatch.setattr(runs, "FILE_BYTES", 2000)
    dense = np.arange(1, 1001, dtype=np.float32).reshape(100, 10)
    made = encoded(dense, np.arange(100))
    assert len(made) > 1 and sum(n for _, n in made) == 100
    assert np.concatenate([v for b, _ in made for _, _, v in runs.entries(b)]).tolist() == dense.ravel().tolist()


@pytest.mark.parametrize("parts", [1, 3])
def test_leaf_of_entries(spark, tmp_path, parts):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, 10), (2, 11), (1, 12), (3, 13)], "group_id int, node_id int")
    own = spark.createDataFrame([(12, 2, 1.5), (10, 0, 1.0), (11, 1, 0.0)], "node_id int, idx long, val double")
    shared = spark.createDataFrame([(1, 3, 2.0), (2, 0, 4.0)], "group_id int, idx long, val double")
    a, b = catalog.lexical_path(root, "lexeme", "own"), catalog.lexical_path(root, "lexeme", "shared")
    for features, leaf in ((own, a), (shared, b)):
        catalog.write_entries(features, rows, 4, leaf, "about", [11.0, 13.0][: parts - 1], parts)
    wanted = ([[1, 0, 0, 0], [0] * 4, [0, 0, 1.5, 0], [0] * 4], [[0, 0, 0, 2], [4, 0, 0, 0], [0, 0, 0, 2], [0] * 4])
    for leaf, vectors in zip((a, b), wanted, strict=True):
        files = sorted((tmp_path / leaf[len(root) + 1 :]).glob("*.parquet"))
        found = [r for f in files for r in pq.ParquetFile(f).read().to_pylist()]
        assert [r["node_id"] for r in found] == [10, 11, 12, 13] and [r["vector"] for r in found] == vectors  # in order over all files
        assert spark.read.parquet(leaf).count() == 4 and catalog.is_written(leaf, spark)
    got = catalog.read_entries(spark, root, lambda v: v["construction"], unit="lexeme").collect()
    assert sorted(map(tuple, got)) == [("own", 10, 0, 1.0), ("own", 12, 2, 1.5), ("shared", 10, 3, 2.0), ("shared", 11, 0, 4.0), ("shared", 12, 3, 2.0)]
    assert catalog.read_entries(spark, root, str, unit="none") is None
    with pytest.raises(Exception, match="an entry at 2 of vectors of 2"):
        catalog.write_entries(own, rows, 2, a, "", [], 1)
    with pytest.raises(IndexError, match="no vectors"):
        catalog.write_entries(own.limit(0), rows.limit(0), 4, a, "", [], 1)
    assert not catalog.is_written(a, spark)


def test_zeros_cost_nothing(spark, tmp_path):
    """A thousand rows of two million values, 8 GB in dense form, are written and read from their entries."""
    root = str(tmp_path)
    rows = spark.range(1000).selectExpr("cast(id as int) as group_id", "cast(id as int) as node_id")
    entries = rows.selectExpr("node_id", "cast(node_id * 1999 as bigint) as idx", "1.0D as val")
    began = time.time()
    catalog.write_entries(entries, rows, 2_000_000, catalog.lexical_path(root, "lexeme", "icf"), "about", [], 1)
    got = catalog.read_entries(spark, root, lambda v: v["unit"]).selectExpr("sum(idx)", "sum(val)").first()
    assert tuple(got) == (999 * 500 * 1999, 1000.0)
    assert time.time() - began < 60 and sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 1_000_000


def test_rounding_is_that_of_round(spark):
    from pyspark.sql import functions as F

    from lexspace.queries import _to_four

    some = np.concatenate([np.random.default_rng(1).normal(size=2000) * 3, np.arange(-40, 40) / 32, [1e-6, 4.99e-5, 5e-5, 3e9, 0.0]]).astype(np.float32)
    df = spark.createDataFrame([(float(x),) for x in some], "x double")
    assert df.where(~(_to_four(F.col("x")) == F.round("x", 4) + F.lit(0.0))).count() == 0


def test_lexical_datasets_are_made_of_entries(spark, tmp_path):
    """Neither words nor shuffles are written value by value."""
    from lexspace.plans import pipeline
    from fixtures import groups, weights

    nested, w = groups(spark, [["A", "B"], ["B"]], [["C"]]), weights(spark, A=1.0, B=2.0, C=3.0)
    pipeline.generate(nested, {"homograph": w}, str(tmp_path), ("homograph",), ("tf_icf", "icf_position_mean_psalm"))
    pipeline.generate_shuffled_segments(nested, w, str(tmp_path), 1)
    files = list(tmp_path.rglob("*.parquet"))
    assert len(files) == 3 and all(pq.ParquetFile(f).metadata.created_by == runs.CREATED_BY and pq.read_table(f).num_rows == 3 for f in files)
