"""Adapters: annotated collections as canonical relations.

    segments(group_id, n, seg_idx, node_id)                 n = segments of the group
    tokens(group_id, n, seg_idx, node_id, tok_idx, value)   value may not be null

Nested tables hold one group in a row: its key, one array of node ids and aligned arrays of words (or texts) for each segment. Flat
tables hold one word in a row. A group or word delivered repeatedly counts once. `segments` owns row existence: a segment without
words keeps its row.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspace.functions.text import strip_marks, strip_space

LEXICAL_COLUMNS = ("number", "half_verse_lexemes", "half_verse_forms", "half_verse_nodes")
SURFACE_COLUMNS = ("number", "half_verse_consonantal", "half_verse_vocalized", "half_verse_cantillation", "half_verse_nodes")
TEXT_COLUMNS = ("number", "half_verses", "half_verses_unvocalized", "half_verses_niqqud_only", "half_verse_nodes")
WORD_COLUMNS = ("node", "half_verse_node", "number", "lex", "lex0", "freq_lex", "g_cons", "g_word", "trailer")

#: unit -> (its column in nested tables, its expression over flat words)
UNITS = {
    "homograph": ("half_verse_forms", "lex0"),
    "lexeme": ("half_verse_lexemes", "lex"),
    "consonantal": ("half_verse_consonantal", "g_cons"),
    "vocalized": ("half_verse_vocalized", "g_word"),
    "cantillation": ("half_verse_cantillation", "g_word"),
}
LEXICAL_UNITS = ("homograph", "lexeme")
TIERS = ("consonantal", "vocalized", "cantillation")


def load_corpus(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table at `path` with just the features asked for; a missing local path is a FileNotFoundError, a missing column a RuntimeError."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(f"no corpus data at {path}; pass the folder of the annotated corpus")
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise RuntimeError(f"the corpus at {path} lacks the features {', '.join(missing)}")
    return df.select(*columns) if columns else df


def in_scope(df: DataFrame, book: str, column: str = "book") -> DataFrame:
    """The rows of one book, compared exactly; a book without rows is a RuntimeError."""
    scope = df.where(F.col(column) == book)
    if scope.isEmpty():
        raise RuntimeError(f"the corpus has no book {book!r}")
    return scope


def one_delivery(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the first by `loaded_at` where there is such a column (then by content); rows with a null key are left out."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    at = _at(df)
    rest = [c for c in df.columns if c not in keys and c not in at]
    first = df.groupBy(*keys).agg(F.min(F.struct(*at, *rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _at(df: DataFrame) -> list[str]:
    return [c for c in ("loaded_at",) if c in df.columns]


def _zipped(df: DataFrame, column: str, nodes: str, group: str) -> DataFrame:
    """(group_id, n, seg_idx, node_id, words): groups exploded to segments; arrays of different length are an error."""
    own = one_delivery(df.select(F.col(group).alias("group_id"), F.col(nodes).alias("nodes"), F.col(column).alias("words"), *_at(df)), "group_id")
    same = F.when(F.size("nodes") == F.size("words"), F.arrays_zip("nodes", "words")).otherwise(
        F.when(F.col("nodes").isNull() & F.col("words").isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("segments and nodes differ in number in group "), F.col("group_id").cast("string"))))
    )
    return own.select("group_id", F.size("nodes").alias("n"), F.posexplode(same).alias("seg_idx", "z")).select("group_id", "n", "seg_idx", F.col("z.nodes").alias("node_id"), F.col("z.words").alias("words")).where("node_id is not null")


def segments(df: DataFrame, nodes: str = "half_verse_nodes", group: str = "number") -> DataFrame:
    own = one_delivery(df.select(F.col(group).alias("group_id"), F.col(nodes).alias("nodes"), *_at(df)), "group_id")
    return own.select("group_id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("seg_idx", "node_id")).where("node_id is not null")


def tokens(df: DataFrame, unit: str, nodes: str = "half_verse_nodes", group: str = "number") -> DataFrame:
    """The words of a unit; an unknown unit is a KeyError."""
    flat = _zipped(df, UNITS[unit][0], nodes, group).select("group_id", "n", "seg_idx", "node_id", F.posexplode("words").alias("tok_idx", "value"))
    return flat.where("value is not null")


def containment(flat: DataFrame, parent: str = "number", child: str = "half_verse_node") -> DataFrame:
    """(parent, child, place): which units lie in which, and each one's place among its parent's children in node order."""
    from pyspark.sql import Window

    pairs = flat.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(parent, child).distinct()
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(child)) - 1)


def words(df: DataFrame) -> DataFrame:
    """Flat words, each node once (its first delivery)."""
    rest = [c for c in WORD_COLUMNS if c != "node" and c in df.columns]
    first = df.where("node is not null").groupBy("node").agg(F.min(F.struct("loaded_at", *rest)).alias("w"))
    return first.select("node", *[F.col(f"w.{c}").alias(c) for c in rest])


def unit_value(unit: str) -> Column:
    """A unit's value of a flat word."""
    column = F.col(UNITS[unit][1])
    return strip_marks(column) if unit == "vocalized" else column


def nested_from_words(flat: DataFrame, *units: str) -> DataFrame:
    """(number, nodes, <unit>...): groups rebuilt from flat words, in node order; groups in order of number are left to the reader."""
    by_segment = flat.where("number is not null and half_verse_node is not null").groupBy("number", "half_verse_node").agg(F.array_sort(F.collect_list(F.struct("node", *[unit_value(u).alias(u) for u in units]))).alias("w"))
    own = by_segment.select("number", "half_verse_node", *[F.col(f"w.{u}").alias(u) for u in units])
    by_group = own.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("half_verse_node", *units))).alias("s"))
    return by_group.select("number", F.col("s.half_verse_node").alias("nodes"), *[F.col(f"s.{u}").alias(u) for u in units])


def segment_texts(flat: DataFrame) -> DataFrame:
    """(number, node_id, text, text_consonantal, text_vocalized): each segment's words with what stands after them, joined in order and stripped; vocalized is the stripped text without accents."""

    def joined(word: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("node", F.concat(F.coalesce(F.col(word), F.lit("")), F.coalesce(F.col("trailer"), F.lit(""))).alias("t"))))
        return strip_space(F.array_join(F.transform(ordered, lambda x: x["t"]), ""))

    by = flat.where("half_verse_node is not null").groupBy("number", F.col("half_verse_node").alias("node_id")).agg(joined("g_word").alias("text"), joined("g_cons").alias("text_consonantal"))
    return by.withColumn("text_vocalized", strip_marks(F.col("text")))


def variant(vocalized: bool, niqqud_only: bool = False) -> Column:
    """A segment's text in a nested text table: points only if `niqqud_only`, else in full or consonants only."""
    return F.col("half_verses_niqqud_only" if niqqud_only else "half_verses" if vocalized else "half_verses_unvocalized")
