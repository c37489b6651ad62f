import json
import math

import pytest
from fixtures import groups, weights

from lexspace.functions import dense
from lexspace.plans import catalog, encode, pipeline, registry
from lexspace.plans.constructions import CONSTRUCTIONS
from lexspace.sources.corpus import segments
from pyspark.sql import functions as F

TEXTS = "number int, half_verses array<string>, half_verses_unvocalized array<string>, half_verses_niqqud_only array<string>, half_verse_nodes array<int>"


lengths = lambda: lambda texts: [[float(len(t)), 3.0, 4.0] for t in texts]  # noqa: E731  (sent to the tasks by value)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, ["abcd", None], ["ab", "a"], ["abc", "b"], [100, 101]), (1, ["abcd", None], ["ab", "a"], ["abc", "b"], [100, 101])], TEXTS)


def test_paths_and_names():
    assert catalog.lexical_path("/r/", "homograph", "icf") == "/r/type=lexical/unit=homograph/construction=icf"
    assert catalog.lexical_path("/r", "word", "icf", "vocalized") == "/r/type=lexical/unit=word/text=vocalized/construction=icf"
    assert catalog.semantic_path("/r", "bge_m3", "vocalized") == "/r/type=semantic/model=bge_m3/text=vocalized"
    assert registry.dataset_name("bge-m3", "vocalized") == "semantic_bge_m3_vocalized"
    assert "float32[1024]" in registry.dataset_description("bge-m3", registry.VARIATIONS[0])


def test_registry(spark):
    assert [v.name for v in registry.variations_for_model("alephbert")] == ["consonantal"]
    assert len(registry.variations_for_model("gemini")) == 3
    assert registry.model_variations(spark).count() == 43 and len(registry.MODELS) == 17
    assert len(registry.models_for_choice(None)) == 6 and registry.models_for_choice("f2llm")[0].dim == 5120
    for bad in (lambda: registry.variations_for_model("x"), lambda: registry.models_for_choice("gemini")):
        with pytest.raises(KeyError):
            bad()


def test_write_and_read(spark, tmp_path):
    leaf = catalog.lexical_path(str(tmp_path), "lexeme", "icf")
    assert not catalog.is_written(leaf)
    catalog.write_dataset(spark.createDataFrame([(3, [1.0, 2.0]), (1, [0.5, 0.0])], "node_id int, vector array<float>"), leaf, "about")
    assert catalog.is_written(leaf) and json.load(open(f"{leaf}/_dataset.json"))["dimension"] == 2
    assert [r.node_id for r in spark.read.parquet(leaf).collect()] == [1, 3]
    catalog.write_dataset(spark.createDataFrame([(3, [1.0])], "node_id int, vector array<float>"), catalog.lexical_path(str(tmp_path), "word", "icf", "vocalized"), "about")
    both = catalog.read_datasets(spark, str(tmp_path))
    assert {(r.unit, r.text, r.node_id) for r in both.collect()} == {("lexeme", None, 1), ("lexeme", None, 3), ("word", "vocalized", 3)}
    assert catalog.read_datasets(spark, str(tmp_path), unit="word").count() == 1 and catalog.read_datasets(spark, str(tmp_path), unit="x") is None


def test_empty_or_ragged_vectors_are_errors(spark, tmp_path):
    with pytest.raises(IndexError):
        catalog.write_dataset(spark.createDataFrame([], "node_id int, vector array<float>"), f"{tmp_path}/a", "")
    with pytest.raises(ValueError, match="1 to 2 entries"):
        catalog.write_dataset(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "node_id int, vector array<float>"), f"{tmp_path}/b", "")


def test_generate_writes_once(spark, tmp_path):
    df = groups(spark, [["A", "B", "A"], ["B"], []], [["C"]])
    w = {u: weights(spark, A=1, B=2, C=3) for u in ("lexeme", "homograph")}
    some = ("binary", "icf_position2", "icf_spacing4_psalm")
    done = pipeline.generate(df, w, str(tmp_path), constructions=some)
    assert done == [f"{u}_{c}" for u in ("homograph", "lexeme") for c in some]
    assert pipeline.generate(df, w, str(tmp_path), constructions=some) == []
    rows = spark.read.parquet(catalog.lexical_path(str(tmp_path), "lexeme", "icf_position2")).collect()
    assert {len(r.vector) for r in rows} == {6} and len(rows) == 4
    assert len(CONSTRUCTIONS) == 19


def test_shuffled_datasets(spark, tmp_path):
    df = groups(spark, [["A"], ["B"], []], [["C"]])
    names = pipeline.generate_shuffled(df, weights(spark, A=1, B=2, C=3), str(tmp_path), 2)
    assert names == ["homograph_icf_position_mean_psalm_shuffle01", "homograph_icf_position_mean_psalm_shuffle02"]
    assert pipeline.generate_shuffled_segments(df, weights(spark, A=1, B=2, C=3), str(tmp_path), 1) == ["homograph_icf_position4_shuffle01"]


def test_local_and_api_embeddings(spark, tmp_path, texts):
    root = str(tmp_path)
    assert pipeline.generate_local(texts, root, "bge-m3", lengths, check_dim=False) == [f"semantic_bge_m3_{v}" for v in ("consonantal", "vocalized", "cantillation")]
    assert pipeline.generate_local(texts, root, "bge-m3", lengths, check_dim=False) == []
    assert pipeline.generate_local(texts, root, "alephbert", lengths, variation="vocalized", check_dim=False) == []
    rows = {r.node_id: list(r.vector) for r in spark.read.parquet(catalog.semantic_path(root, "bge_m3", "cantillation")).collect()}
    assert rows[100] == pytest.approx([x / math.sqrt(41) for x in (4, 3, 4)]) and rows[101] == pytest.approx([0, 0.6, 0.8])
    with pytest.raises(RuntimeError, match="COHERE_API_KEY"):
        pipeline.generate_api(texts, root, "cohere", lambda t, k: [], {})
    fetch = lambda t, k: [[float(len(x)), float(len(k))] for x in t]
    assert len(pipeline.generate_api(texts, root, "cohere", fetch, {"COHERE_API_KEY": "key"}, check_dim=False)) == 3
    assert pipeline.generate_api(texts, root, "cohere", fetch, {}, check_dim=False) == []
    got = {r.node_id: list(r.vector) for r in spark.read.parquet(catalog.semantic_path(root, "cohere_embed_v4", "consonantal")).collect()}
    assert got == {100: [2.0, 3.0], 101: [1.0, 3.0]}


@pytest.mark.parametrize(("encoder", "message"), [(lambda t: [], "no embeddings"), (lambda t: [[1.0]], "1 embeddings for 2"), (lambda t: [[1.0]] * 2, "instead of 2"), (lambda t: [[1.0, math.nan]] * 2, "aren't finite after 3")])
def test_bad_embeddings(spark, encoder, message):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "node_id int, text string").coalesce(1)
    with pytest.raises(Exception, match=message):
        encode.encode(rows, lambda: encoder, dim=2, attempts=3).collect()


def test_a_later_attempt_counts(spark):
    rows = spark.createDataFrame([(1, "a")], "node_id int, text string")

    def factory(made=[]):  # noqa: B006
        made.append(1)
        return lambda t: [[math.nan if len(made) < 2 else 1.0] for _ in t]

    assert [list(r.vector) for r in encode.encode(rows, factory, attempts=5).collect()] == [[1.0]]


def test_batches_and_spans(spark):
    own = segments(groups(spark, [["A"]] * 250, [["A"]] * 3))
    sizes = {(r.group_id, r.batch): r["count"] for r in encode.batch_numbers(own, 96, "seg_idx").groupBy("group_id", "batch").count().collect()}
    assert sizes == {(1, 0): 96, (1, 1): 96, (1, 2): 58, (2, 0): 3}
    assert {(r.group_id, r.start, r.end) for r in encode.spans(own).collect()} == {(1, 0, 250), (2, 250, 253)}


def test_groups_without_embeddings_are_absent(spark):
    own = segments(groups(spark, [["A"]] * 2, [["A"]] * 2))
    emb = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "group_id int, seg_idx int, vector array<float>")
    assert {r.node_id for r in encode.node_vectors(emb, own).collect()} == {100, 101}


def test_dense_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 0.0])], "a array<float>, z array<float>, b array<double>")
    got = row.select(dense.norm(F.col("a")).alias("n"), dense.cosine(F.col("a"), F.col("z")).alias("c0"), dense.cosine(F.col("a"), F.col("b")).alias("c"), dense.normalised(F.col("a")).alias("u"), dense.normalised(F.col("z")).alias("v")).first()
    assert got.n == 5 and got.c0 == 0 and got.c == pytest.approx(0.6) and got.u == pytest.approx([0.6, 0.8]) and got.v == [0, 0]
    finite = spark.createDataFrame([([1.0, math.nan],), ([math.inf],), ([1.0],)], "v array<double>").select(dense.all_finite(F.col("v")).alias("f")).collect()
    assert [r.f for r in finite] == [False, False, True]
    back = dense.sparsify(spark.createDataFrame([(1, [0.0, 2.0])], "node_id int, vector array<float>")).collect()
    assert [(r.node_id, r.idx, r.val) for r in back] == [(1, 1, 2.0)]


def test_last_token_pooling(spark):
    schema = "hidden array<array<double>>, mask array<int>"
    right = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0], [5.0, 5.0]], [1, 1, 0]), ([[1.0, 0.0], [0.0, 2.0], [3.0, 4.0]], [1, 1, 1])], schema)
    assert sorted(list(r.vector) for r in dense.last_token_pooled(right).collect()) == [[0.0, 1.0], [0.6, 0.8]]
    left = spark.createDataFrame([([[9.0, 9.0], [0.0, 2.0], [3.0, 4.0]], [0, 1, 1])], schema)
    assert list(dense.last_token_pooled(left).first().vector) == pytest.approx([0.6, 0.8])


def test_rotary(spark):
    got = {(r.position, r.i): (r.cos, r.sin) for r in dense.rotary_tables(spark, 3, 4).collect()}
    assert got[2, 1] == pytest.approx((math.cos(2 / 100), math.sin(2 / 100))) and len(got) == 6
