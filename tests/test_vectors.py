import math

import pytest
from fixtures import groups, long, weights

from lexspace.functions.dense import densify
from lexspace.operators import vectors
from lexspace.operators.vocabulary import dictionary, icf_vector, vocabulary
from lexspace.plans.constructions import CONSTRUCTIONS, build, prepare
from lexspace.sources.corpus import segments, tokens


def made(spark, name, *segs, **w):
    return long(build(name, prepare(groups(spark, [*segs]), "lexeme", weights=weights(spark, **w) if w else None)))


def test_counts(spark):
    assert made(spark, "count", ["A", "A", "A", "B"]) == {100: {0: 3, 1: 1}}


def test_binary(spark):
    assert made(spark, "binary", ["A", "A", "A"], ["B"]) == {100: {0: 1}, 101: {1: 1}}


def test_log_count(spark):
    assert made(spark, "log_count", ["A", "A", "A"], ["B"])[100] == {0: round(math.log(4), 9)}


def test_icf_and_tf_icf(spark):
    assert made(spark, "icf", ["A", "A"], ["B"], A=2.5, B=0.1) == {100: {0: 2.5}, 101: {1: 0.1}}
    assert made(spark, "tf_icf", ["A", "A", "A"], ["B"], A=2, B=5)[100] == {0: round(2 * math.log(4), 9)}


def test_words_out_of_the_vocabulary_are_left_out(spark):
    words = tokens(groups(spark, [["A", "OUT"], ["OUT"]]), "lexeme")
    entries = dictionary(spark.createDataFrame([("A", 0, 1)], "value string, idx int, size long"))
    tf = vectors.term_frequency(words, entries)
    assert long(vectors.count(tf)) == {100: {0: 1}}
    dense = densify(vectors.count(tf), segments(groups(spark, [["A", "OUT"], ["OUT"]])), 1)
    assert {r.node_id: list(r.vector) for r in dense.collect()} == {100: [1.0], 101: [0.0]}


def test_value_without_weight_is_an_error(spark):
    with pytest.raises(Exception, match="no weight for the value B"):
        made(spark, "icf", ["A", "B"], A=1)


def test_vocabulary_is_sorted_by_code_point(spark):
    v = vocabulary(tokens(groups(spark, [["B", "W"], ["A", "B"]], [["é", "z", "AB", "א"]]), "lexeme"))
    rows = sorted(v.collect(), key=lambda r: r.idx)
    assert [r.value for r in rows] == sorted(["A", "B", "W", "é", "z", "AB", "א"])
    assert [r.idx for r in rows] == list(range(7)) and {r["size"] for r in rows} == {7}


def test_empty_vocabulary(spark):
    assert vocabulary(tokens(groups(spark, [[], [None]]), "lexeme")).count() == 0


def test_icf_vector(spark):
    v = vocabulary(tokens(groups(spark, [["B", "A"]]), "lexeme"))
    assert {(r.idx, r.val) for r in icf_vector(dictionary(v, weights(spark, A=2, B=3))).collect()} == {(0, 2.0), (1, 3.0)}


def test_segments_and_nodes_must_agree(spark):
    bad = spark.createDataFrame([(1, [["A"], ["B"]], [["A"], ["B"]], [100])], "number int, half_verse_lexemes array<array<string>>, half_verse_forms array<array<string>>, half_verse_nodes array<int>")
    with pytest.raises(Exception, match="differ in number in group 1"):
        tokens(bad, "lexeme").collect()


def test_repeated_delivery_counts_once(spark):
    df = groups(spark, [["A", "A"], ["B"]])
    assert long(build("count", prepare(df.unionByName(df), "lexeme"))) == {100: {0: 2}, 101: {1: 1}}


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="unknown construction"):
        build("none", prepare(groups(spark, [["A"]]), "lexeme"))
    with pytest.raises(KeyError):
        tokens(groups(spark, [["A"]]), "none")


def test_all_empty_segment_under_every_construction(spark):
    df = groups(spark, [["A", "B", "A"], [], ["B"], None])
    p = prepare(df, "lexeme", weights=weights(spark, A=2, B=3))
    assert len(CONSTRUCTIONS) == 19
    for name, (_, dim) in CONSTRUCTIONS.items():
        rows = {r.node_id: list(r.vector) for r in densify(build(name, p), p.segments, dim(2)).collect()}
        assert set(rows) == {100, 101, 102, 103}, name
        assert {len(v) for v in rows.values()} == {dim(2)}, name
        assert all(math.isfinite(x) for v in rows.values() for x in v), name
        if not name.endswith("_psalm"):
            assert not any(rows[101]) and not any(rows[103]), name
