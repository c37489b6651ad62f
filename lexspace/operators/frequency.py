"""Corpus frequencies and the weights made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspace.sources.corpus import TIERS, unit_value, words


def total_tokens(corpus: DataFrame) -> DataFrame:
    """(total): words of the corpus, each node once."""
    return corpus.where("node is not null").agg(F.count_distinct("node").alias("total"))


def lexeme_frequency(corpus: DataFrame) -> DataFrame:
    """(value, f): of each lexeme the frequency that its first word with one states."""
    return _first(corpus).select(F.col("lex").alias("value"), F.col("x.freq_lex").cast("long").alias("f"))


def homograph_frequency(corpus: DataFrame) -> DataFrame:
    """(value, f): of each homograph the sum of its lexemes' frequencies, each lexeme with the homograph of its first word."""
    first = _first(corpus).select(F.col("x.lex0").alias("value"), F.col("x.freq_lex").cast("long").alias("f"))
    return first.where("value is not null").groupBy("value").agg(F.sum("f").alias("f"))


def _first(corpus: DataFrame) -> DataFrame:
    # repeated deliveries of a node are equal, so the first word needs no deduplication
    known = corpus.where("node is not null and lex is not null and lex0 is not null and freq_lex is not null")
    # the distinct statements of each lexeme are few, so the hash aggregate leaves next to nothing to sort by the first node
    stated = known.groupBy("lex", "lex0", "freq_lex").agg(F.min("node").alias("node"))
    return stated.groupBy("lex").agg(F.min(F.struct("node", "lex0", "freq_lex")).alias("x"))


def surface_frequency(corpus: DataFrame, tier: str) -> DataFrame:
    """(value, f): occurrences of each surface form."""
    if tier not in TIERS:
        raise KeyError(tier)
    return surface_counts(surface_words(corpus), tier)


def surface_words(corpus: DataFrame) -> DataFrame:
    """(node, g_cons, g_word): the words that all tiers are counted over."""
    return words(corpus.select("node", "g_cons", "g_word", "loaded_at"))


def surface_counts(once: DataFrame, tier: str) -> DataFrame:
    """(value, f) over `surface_words`."""
    return once.select(unit_value(tier).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("f"))


def frequency(corpus: DataFrame, unit: str) -> DataFrame:
    """(value, f) of a unit."""
    if unit == "lexeme":
        return lexeme_frequency(corpus)
    return homograph_frequency(corpus) if unit == "homograph" else surface_frequency(corpus, unit)


def icf_weights(frequencies: DataFrame, total: DataFrame) -> DataFrame:
    """(value, f, w): w = ln((T+1)/(f+1)) + 1; less than 1 where f exceeds T."""
    return frequencies.crossJoin(F.broadcast(total)).select("value", "f", (F.log((F.col("total") + 1) / (F.col("f") + 1)) + 1).alias("w"))  # total is one row
