from fixtures import groups, long, weights

from lexspace.operators.vocabulary import dictionary, vocabulary
from lexspace.plans.constructions import build, prepare
from lexspace.sources.corpus import tokens
from lexspace.streaming.incremental import read_incremental, stream_vectors


def test_new_groups_are_added_once(spark, tmp_path):
    every = groups(spark, [["A", "B", "A"], ["B"]], [["C", "A"]])
    w = weights(spark, A=1, B=2, C=3)
    entries = dictionary(vocabulary(tokens(every, "lexeme")), w)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (every.where("number = 1"), every):  # group 1 is delivered again
        part.write.mode("append").parquet(source)
        stream_vectors(spark, source, every.schema, "lexeme", "tf_icf", entries, target, checkpoint).awaitTermination()
    assert long(read_incremental(spark, target)) == long(build("tf_icf", prepare(every, "lexeme", weights=w)))
