"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["lexeme_icf", "homograph_icf_spacing4", "lexeme_icf_position_mean_psalm", "word_vocalized_tf_icf", "word_cantillation_icf_position8", "word_consonantal_icf_spacing2_psalm", "frequency_homograph", "vocabulary_cantillation", "segment_text", "groups_from_words", "icf_position4_shuffle", "vector_norms", "dense_icf", "loaded_surface_psalm", "loaded_psalm", "acquired_corpus", "scope_of_book", "lexeme_tf_icf_of_book", "words_in_segments", "aligned_layers", "node_vectors_join", "pooled_last_token",
        "encode_with_retries", "encode_last_tokens", "fetched_vectors", "providers", "model_loading", "model_datasets", "large_model_choices", "groups_in_order", "strict_icf", "out_of_vocabulary", "dataset_plan", "written_order",
        "command_shuffle_segments", "command_semantic", "command_large", "new_datasets"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(n.split("_")[0] in ("lexeme", "homograph", "word") for n in entry.queries()) >= 95
