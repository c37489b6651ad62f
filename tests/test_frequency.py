import datetime
import math

import pytest
from pyspark.sql import functions as F

from lexspace.functions.text import strip_marks, strip_space
from lexspace.operators import frequency
from lexspace.sources.corpus import containment, in_scope, load_corpus, nested_from_words, one_delivery, segment_texts, words

WORDS = "node int, half_verse_node int, number int, lex string, lex0 string, freq_lex int, g_cons string, g_word string, trailer string, loaded_at timestamp"
AT = datetime.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def corpus(spark):
    # two lexemes "gate" and "gates" of the homograph "gat", "river" alone with two statements, and a word without analysis
    rows = [
        (11, 70, 7, "gate", "gat", 40, "שער", "שע֑ר", " ", AT),
        (12, 70, 7, "gates", "gat", 17, "שערים", "שערים", "\n", AT),
        (13, 71, 7, "gate", "gat", 40, "שער", "שער", "", AT),
        (14, 71, 7, "river", "riv", 6, "נהר", "נהר", "־", AT),
        (15, 72, 8, "river", "riv", 88, None, None, None, AT),
        (16, 72, 8, "well", "wel", 2, "באר", "בא֔ר", " ", AT),
    ]
    late = [(*r[:-1], AT + datetime.timedelta(days=9)) for r in rows[1:4]]
    return spark.createDataFrame([*rows, *late, (17, 72, 8, None, None, None, "נהר", "נהר", "", AT)], WORDS)


def of(df):
    return {r.value: r.f for r in df.collect()}


def test_frequencies(corpus):
    assert frequency.total_tokens(corpus).first().total == 7
    assert of(frequency.frequency(corpus, "lexeme")) == {"gate": 40, "gates": 17, "river": 6, "well": 2}
    assert of(frequency.frequency(corpus, "homograph")) == {"gat": 57, "riv": 6, "wel": 2}
    assert of(frequency.frequency(corpus, "cantillation")) == {"שע֑ר": 1, "שערים": 1, "שער": 1, "נהר": 2, "בא֔ר": 1}
    assert of(frequency.frequency(corpus, "vocalized")) == {"שער": 2, "שערים": 1, "נהר": 2, "באר": 1}
    assert of(frequency.frequency(corpus, "consonantal")) == {"שער": 2, "שערים": 1, "נהר": 2, "באר": 1}
    with pytest.raises(KeyError):
        frequency.surface_frequency(corpus, "none")


def test_weights_may_fall_below_one(spark):
    f = spark.createDataFrame([("often", 29), ("seldom", 1)], "value string, f long")
    total = spark.createDataFrame([(9,)], "total long")
    got = {r.value: r.w for r in frequency.icf_weights(f, total).collect()}
    assert got == pytest.approx({"often": 1 - math.log(3), "seldom": 1 + math.log(5)})
    assert frequency.icf_weights(f.limit(0), total).count() == 0


def test_texts_of_segments(corpus):
    got = {r.node_id: (r.text, r.text_consonantal, r.text_vocalized) for r in segment_texts(words(corpus)).collect()}
    assert got[70] == ("שע֑ר שערים", "שער שערים", "שער שערים") and got[71] == ("שערנהר־",) * 3 and got[72] == ("בא֔ר נהר", "באר נהר", "באר נהר")


def test_groups_from_words(corpus):
    got = {r.number: r for r in nested_from_words(words(corpus), "lexeme", "vocalized").collect()}
    assert got[7].nodes == [70, 71] and got[7].lexeme == [["gate", "gates"], ["gate", "river"]] and got[7].vocalized == [["שער", "שערים"], ["שער", "נהר"]]
    assert got[8].lexeme == [["river", "well", None]]


def test_containment(corpus):
    assert {(r.number, r.half_verse_node, r.place) for r in containment(corpus).collect()} == {(7, 70, 0), (7, 71, 1), (8, 72, 0)}
    assert {(r.half_verse_node, r.node, r.place) for r in containment(corpus, "half_verse_node", "node").where("half_verse_node = 72").collect()} == {(72, 15, 0), (72, 16, 1), (72, 17, 2)}


def test_the_first_delivery_counts(spark):
    rows = [(1, "late", AT + datetime.timedelta(days=1)), (1, "first", AT), (2, "only", AT), (None, "none", AT)]
    got = one_delivery(spark.createDataFrame(rows, "number int, text string, loaded_at timestamp"), "number").collect()
    assert {(r.number, r.text) for r in got} == {(1, "first"), (2, "only")}


def test_text_functions(spark):
    row = spark.sql("select 'אָ֑' as a, '\\u2003 x y\\n\\u00a0' as b")
    got = row.select(strip_marks(F.col("a")).alias("a"), strip_space(F.col("b")).alias("b")).first()
    assert (got.a, got.b) == ("אָ", "x y")


def test_loading(spark, tmp_path, corpus):
    with pytest.raises(FileNotFoundError, match="annotated corpus"):
        load_corpus(spark, str(tmp_path / "none"))
    corpus.write.parquet(str(tmp_path / "words"))
    assert load_corpus(spark, str(tmp_path / "words"), ("node", "lex")).columns == ["node", "lex"]
    with pytest.raises(RuntimeError, match="lacks the features colour"):
        load_corpus(spark, str(tmp_path / "words"), ("node", "colour"))


def test_scope(spark):
    df = spark.createDataFrame([("A", 1), ("a", 2), (None, 3)], "book string, number int")
    assert [r.number for r in in_scope(df, "A").collect()] == [1]
    with pytest.raises(RuntimeError, match="no book 'B'"):
        in_scope(df, "B")
