"""How characteristic each term is of each record: positive pointwise mutual information.

From the joint counts tf(term, record) and the marginal counts of terms and records: with context counts smoothed
by an exponent a (0.75), P(record) = size^a / sum of size^a, and
    ppmi = max(0, ln(tf / T / (P(term) * P(record)))), P(term) = occurrences / T.
The same joint counts give tf_icf = ln(1+tf) * (ln((N+1)/(df+1)) + 1), the measure the engine weights its vectors by; `most_distinctive` ranks by it.

Only group-bys, joins and sums over a record: one shuffle makes the joint counts, each aggregated before it is sent; they are written once, and the marginals of terms and
records are aggregates of them. A term that most records have is one row for each record in the joint counts, never a group in one task; the join with the
marginal counts is left to the planner (broadcast while they are small, sorted beyond, split where skewed).

Null keys are left out, repeated deliveries of a key count once, null terms are left out, the empty string is a term like others; a record without terms counts in N;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspace.storage import materialise

SMOOTHING = 0.75


def joint_counts(records: DataFrame) -> DataFrame:
    """(field, number, term, tf) of records (field, number, words)."""
    clean = records.select("field", F.col("number").cast("long").alias("number"), "words").where("field is not null and number is not null")
    # all records are moved by key once, so their terms need no further shuffle to be counted
    once = clean.groupBy("field", "number").agg(F.min("words").alias("words"))
    words = once.select("field", "number", F.explode("words").alias("term")).where("term is not null")
    return words.groupBy("field", "number", "term").agg(F.count("*").alias("tf"))


def association(records: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(field, number, term, tf, df, ppmi, tf_icf) of every term of every record."""
    keys = records.select("field", F.col("number").cast("long").alias("number")).where("field is not null and number is not null")
    sizes = keys.groupBy("field").agg(F.count_distinct("number").alias("n"))
    joint = materialise(joint_counts(records), "p3-joint")
    terms = joint.groupBy("field", "term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("df"))
    by_record = joint.groupBy("field", "number").agg(F.sum("tf").alias("size"))
    totals = by_record.groupBy("field").agg(F.sum("size").alias("tokens"), F.sum(F.pow("size", F.lit(smoothing))).alias("context")).join(sizes, "field")
    size = F.sum("tf").over(Window.partitionBy("field", "number"))
    # the window comes last, so that a ranking of each record's terms needs no further shuffle
    all_ = joint.join(terms, ["field", "term"]).withColumn("size", size).join(F.broadcast(totals), "field")  # one row for each field
    ppmi = F.greatest(F.lit(0.0), F.log(F.col("tf") * F.col("context") / (F.col("occurrences") * F.pow("size", F.lit(smoothing)))))
    return all_.select("field", "number", "term", "tf", "df", ppmi.alias("ppmi"), tf_icf("tf", "df", "n").alias("tf_icf"))


def tf_icf(tf: str, df: str, n: str) -> Column:
    return F.log1p(F.col(tf)) * (F.log((F.col(n) + 1) / (F.col(df) + 1)) + 1)


def most_distinctive(records: DataFrame, least_records: int = 2, within: float = 1e-9, by: str = "tf_icf") -> DataFrame:
    """Of each record the terms with the highest score, all that tie within `within`, among the terms of at least `least_records` records."""
    shared = association(records).where(F.col("df") >= least_records)
    top = F.max(by).over(Window.partitionBy("field", "number"))
    return shared.withColumn("top", top).where(F.col(by) >= F.col("top") - within).drop("top")
