"""Small groups in the shape of the nested tables."""

from pyspark.sql import Row

LEXICAL = "number int, half_verse_lexemes array<array<string>>, half_verse_forms array<array<string>>, half_verse_nodes array<int>"


def groups(spark, *groups_, nodes=None):
    """Groups of segments of words; node ids 100, 101, ... in each, 1000 apart."""
    rows = [(i + 1, g, g, nodes[i] if nodes else [100 + 1000 * i + j for j in range(len(g))]) for i, g in enumerate(groups_)]
    return spark.createDataFrame(rows, LEXICAL)


def weights(spark, **w):
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()] or [], "value string, w double")


def long(df):
    """{node: {idx: val}} of long-form vectors."""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.node_id, {})[r.idx] = round(r.val, 9)
    return out


__all__ = ["LEXICAL", "Row", "groups", "long", "weights"]
