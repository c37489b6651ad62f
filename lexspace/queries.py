"""Registered queries of the core, over the psalm tables, and their SQL for DuckDB.

Groups are psalms, segments half-verses, tokens words; the corpus whose frequencies make the weights is corpus_word.
"""

from __future__ import annotations

import os
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspace.functions.dense import all_finite, densify, last_token_pooled, norm, rotary_tables, sparsify
from lexspace.functions.text import strip_marks, strip_space
from lexspace.operators import frequency as freq
from lexspace.operators import position, recurrence, vectors
from lexspace.operators.shuffle import numpy_order, shuffled_order
from lexspace.operators.vocabulary import dictionary, vocabulary
from lexspace.plans import pipeline
from lexspace.plans.catalog import listing, new_leaves, not_written, read_datasets, read_entries
from lexspace.plans.constructions import CONSTRUCTIONS, GROUP_CONSTRUCTIONS, Prepared, build, prepare
from lexspace.plans.encode import KEY_VARIABLES, batch_numbers, encode, group_order, node_vectors, spans
from lexspace.plans.fetchers import PROVIDERS, fetcher
from lexspace.plans.models import CHECKPOINTS, acquired, loading, local_encoder
from lexspace.plans.pipeline import text_segments
from lexspace.plans.registry import BY_SLUG, large_models, model_variations
from lexspace.sources.corpus import LEXICAL_COLUMNS, LEXICAL_UNITS, SURFACE_COLUMNS, TEXT_COLUMNS, UNITS, WORD_COLUMNS, containment, in_scope, load_corpus, nested_from_words, segment_texts, segments, tokens, words
from lexspace.storage import new_path, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEEDS = [1, 2, 3]
BOOK = "Sefer Alef"


def nested_table(unit: str) -> str:
    return "lexical_psalm" if unit in LEXICAL_UNITS else "surface_psalm"


def unit_name(unit: str) -> str:
    return unit if unit in LEXICAL_UNITS else f"word_{unit}"


def prepared(spark: SparkSession, sf: str, unit: str) -> Prepared:
    return prepare(table(spark, sf, nested_table(unit)), unit, table(spark, sf, "corpus_word"), strict=False)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


# --- SQL pieces -------------------------------------------------------------------------------------------------

_MARKS_SQL = r"'[\x{0591}-\x{05AF}]', '', 'g'"
_WORDS = "w as (select node, w.* from (select node, first(c order by loaded_at) as w from (select node, loaded_at, struct_pack(half_verse_node := half_verse_node, number := number, lex := lex, lex0 := lex0, freq_lex := freq_lex, g_cons := g_cons, g_word := g_word, trailer := trailer) as c from corpus_word where node is not null) group by node))"
_TOTAL = "tot as (select count(distinct node) as total from corpus_word where node is not null)"
_FIRST = "fl as (select lex, first(lex0 order by node) as lex0, first(freq_lex order by node) as f from corpus_word where node is not null and lex is not null and lex0 is not null and freq_lex is not null group by lex)"


def _value_sql(unit: str) -> str:
    column = UNITS[unit][1]
    return f"regexp_replace({column}, {_MARKS_SQL})" if unit == "vocalized" else column


def _frequency_sql(unit: str) -> str:
    """CTEs up to fr(value, f)."""
    if unit == "lexeme":
        return f"{_FIRST}, fr as (select lex as value, cast(f as bigint) as f from fl)"
    if unit == "homograph":
        return f"{_FIRST}, fr as (select lex0 as value, cast(sum(f) as bigint) as f from fl group by lex0)"
    return f"{_WORDS}, fr as (select {_value_sql(unit)} as value, count(*) as f from w where {UNITS[unit][1]} is not null group by 1)"


def _tokens_sql(unit: str, source: str | None = None) -> str:
    """CTEs up to seg(group_id, n, seg_idx, node_id) and tok(group_id, n, seg_idx, node_id, tok_idx, value)."""
    name, column = source or nested_table(unit), UNITS[unit][0]
    return f"""g as (select number as group_id, first(half_verse_nodes order by loaded_at) as nodes, first({column} order by loaded_at) as ws from {name} where number is not null group by number),
s0 as (select group_id, len(nodes) as n, unnest(range(len(nodes))) as seg_idx, unnest(nodes) as node_id, unnest(ws) as w from g),
seg as (select group_id, n, seg_idx, node_id from s0 where node_id is not null),
tok as (select * from (select group_id, n, seg_idx, node_id, unnest(range(len(w))) as tok_idx, unnest(w) as value from s0 where node_id is not null) where value is not null)"""


def _tf_sql(unit: str, source: str | None = None) -> str:
    """CTEs up to tf(group_id, n, seg_idx, node_id, idx, size, w, tf)."""
    return f"""with {_tokens_sql(unit, source)}, {_TOTAL}, {_frequency_sql(unit)},
voc as (select value, row_number() over (order by value) - 1 as idx, count(*) over () as size from (select distinct value from tok)),
dic as (select value, idx, size, coalesce(ln((total + 1) / (f + 1)), ln(total + CAST(1 AS DOUBLE))) + 1 as w from voc left join fr using (value), tot),
tf as (select group_id, n, seg_idx, node_id, idx, size, w, count(*) as tf from tok join dic using (value) group by all)"""


_ROUND = "cast(idx as bigint) as idx, round(val, 6) + 0.0 as val"
_T = "((seg_idx + CAST(0.5 AS DOUBLE)) / n)"


def _bin_sql(k: int) -> str:
    return f"cast(least(floor({_T} * {k}), {k - 1}) as bigint)"


_COS = """u as (select group_id, n, seg_idx, node_id, idx, w / sqrt(sum(w * w) over (partition by node_id)) as u from tf where w <> 0),
c as (select a.group_id, a.seg_idx as i, b.seg_idx as j, sum(a.u * b.u) as cos from u a join u b on a.group_id = b.group_id and a.idx = b.idx and a.seg_idx < b.seg_idx group by all)"""


def _lag_sql(k: int) -> str:
    return f"cast(least(floor((b.seg_idx - a.seg_idx) * CAST({k} AS DOUBLE) / (a.n - 1)), {k - 1}) as bigint)"


def construction_sql(name: str, unit: str) -> str:
    tf = _tf_sql(unit)
    simple = {"binary": "CAST(1 AS DOUBLE)", "count": "cast(tf as double)", "log_count": "ln(1 + tf)", "icf": "w", "tf_icf": "ln(1 + tf) * w"}
    if name in simple:
        return f"{tf} select node_id, cast(idx as bigint) as idx, round({simple[name]}, 6) as val from tf"
    group, base = name.endswith("_psalm"), name.removesuffix("_psalm")
    if base == "icf_position_mean":
        if group:
            return f"""{tf}, z as (select group_id, idx, size, w, avg({_T}) as t from tf group by all),
h as (select group_id, idx, w as val from z union all select group_id, size + idx, w * (2 * t - 1) from z)
select node_id, {_ROUND} from seg join h using (group_id)"""
        return f"{tf}, h as (select node_id, idx, w as val from tf union all select node_id, size + idx, w * (2 * {_T} - 1) from tf) select node_id, {_ROUND} from h"
    k = int(base[-1])
    if base.startswith("icf_position"):
        if group:
            return f"{tf}, h as (select group_id, {_bin_sql(k)} * size + idx as idx, sum(w) as val from tf group by all) select node_id, {_ROUND} from seg join h using (group_id)"
        return f"{tf}, h as (select node_id, {_bin_sql(k)} * size + idx as idx, w as val from tf) select node_id, {_ROUND} from h"
    pairs = f"""{tf}, {_COS}, p as (select a.group_id, a.node_id as x, b.node_id as y, {_lag_sql(k)} as bin, coalesce(cos, 0) as cos
from seg a join seg b on a.group_id = b.group_id and a.seg_idx < b.seg_idx left join c on c.group_id = a.group_id and c.i = a.seg_idx and c.j = b.seg_idx)"""
    if group:
        return f"{pairs}, h as (select group_id, bin as idx, avg(cos) as val from p group by all) select node_id, {_ROUND} from seg join h using (group_id)"
    return f"{pairs}, h as (select node_id, bin as idx, avg(cos) as val from (select x as node_id, bin, cos from p union all select y, bin, cos from p) group by all) select node_id, {_ROUND} from h"


# --- constructions ----------------------------------------------------------------------------------------------


def _rounded(by: DataFrame) -> DataFrame:
    """Values as the queries give them; a group's are rounded before they go to its segments, not once for each."""
    return by.withColumn("val", F.round("val", 6) + F.lit(0.0))


def _construction(unit: str, name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = prepared(spark, sf, unit)
        if name in GROUP_CONSTRUCTIONS:
            return position.to_segments(_rounded(GROUP_CONSTRUCTIONS[name](p)), p.segments)
        return _rounded(build(name, p).select("node_id", "idx", "val"))

    return run


for _unit in UNITS:
    for _name in CONSTRUCTIONS:
        add(f"{unit_name(_unit)}_{_name}", _construction(_unit, _name), construction_sql(_name, _unit))

# --- frequencies and vocabularies -------------------------------------------------------------------------------


@query(f"with {_TOTAL} select total from tot")
def total_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return freq.total_tokens(table(spark, sf, "corpus_word"))


def _frequency(unit: str):
    return lambda spark, sf: freq.frequency(table(spark, sf, "corpus_word"), unit)


def _weights(unit: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        corpus = table(spark, sf, "corpus_word")
        return freq.icf_weights(freq.frequency(corpus, unit), freq.total_tokens(corpus)).select("value", "f", F.round("w", 6).alias("w"))

    return run


def _vocabulary(unit: str):
    return lambda spark, sf: vocabulary(tokens(table(spark, sf, nested_table(unit)), unit)).select("value", "idx")


def _icf_vector(unit: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return prepared(spark, sf, unit).dictionary.select("idx", F.round("w", 6).alias("val"))

    return run


def _tokens(unit: str):
    return lambda spark, sf: tokens(table(spark, sf, nested_table(unit)), unit)


for _unit in UNITS:
    add(f"frequency_{_unit}", _frequency(_unit), f"with {_frequency_sql(_unit)} select value, f from fr")
    add(f"icf_weights_{_unit}", _weights(_unit), f"with {_TOTAL}, {_frequency_sql(_unit)} select value, f, round(ln((total + 1) / (f + 1)) + 1, 6) as w from fr, tot")
    add(f"vocabulary_{_unit}", _vocabulary(_unit), f"with {_tokens_sql(_unit)} select value, cast(row_number() over (order by value) - 1 as int) as idx from (select distinct value from tok)")
    add(f"icf_vector_{_unit}", _icf_vector(_unit), f"{_tf_sql(_unit)} select cast(idx as int) as idx, round(w, 6) as val from dic")
    add(f"tokens_{_unit}", _tokens(_unit), f"with {_tokens_sql(_unit)} select group_id, cast(n as int) as n, cast(seg_idx as int) as seg_idx, node_id, cast(tok_idx as int) as tok_idx, value from tok")

# --- sources ----------------------------------------------------------------------------------------------------

_SEG = _tokens_sql("lexeme")


@query(f"with {_SEG} select group_id, cast(n as int) as n, cast(seg_idx as int) as seg_idx, node_id from seg")
def segments_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    return segments(table(spark, sf, "lexical_psalm"))


_SCOPE = f"(select * from lexical_psalm where book = '{BOOK}')"


@query(f"with {_tokens_sql('lexeme', _SCOPE)} select group_id, cast(n as int) as n, cast(seg_idx as int) as seg_idx, node_id, cast(tok_idx as int) as tok_idx, value from tok")
def scope_of_book(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(in_scope(table(spark, sf, "lexical_psalm"), BOOK), "lexeme")


@query(f"{_tf_sql('lexeme', _SCOPE)} select node_id, cast(idx as bigint) as idx, round(ln(1 + tf) * w, 6) as val from tf")
def lexeme_tf_icf_of_book(spark: SparkSession, sf: str) -> DataFrame:
    """One book's vectors over its own vocabulary, weighted by the whole corpus."""
    p = prepare(in_scope(table(spark, sf, "lexical_psalm"), BOOK), "lexeme", table(spark, sf, "corpus_word"), strict=False)
    return build("tf_icf", p).select("node_id", "idx", F.round("val", 6).alias("val"))


def _loaded_sql(name: str, *columns: str) -> str:
    """All words (or texts) of a nested table as delivered, one row for each."""
    places = ", ".join(f"unnest({c}) as {c}" for c in columns)
    return f"select number, node_id, place, {', '.join(columns)} from (select number, unnest(half_verse_nodes) as node_id, unnest(range(len(half_verse_nodes))) as place, {places} from {name})"


def _loaded(path: str, columns: tuple[str, ...]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        layers = [c for c in columns if c not in ("number", "half_verse_nodes")]
        rows = load_corpus(spark, f"{sf}/{path}.parquet", columns).select("number", F.posexplode(F.arrays_zip("half_verse_nodes", *layers)).alias("place", "z"))
        texts = [(F.array_join(F.col(f"z.{c}"), "|", "?") if path != "psalm" else F.col(f"z.{c}")).alias(c) for c in layers]
        return rows.select("number", F.col("z.half_verse_nodes").alias("node_id"), F.col("place").cast("long").alias("place"), *texts)

    return run


def _layers_sql(name: str, columns: tuple[str, ...]) -> str:
    layers = [c for c in columns if c not in ("number", "half_verse_nodes")]
    words_ = [f"array_to_string(list_transform({c}, lambda x: coalesce(x, '?')), '|') as {c}" if name != "psalm" else c for c in layers]
    return f"select number, node_id, place, {', '.join(words_)} from ({_loaded_sql(name, *layers)})"


for _table, _columns in (("lexical_psalm", LEXICAL_COLUMNS), ("surface_psalm", SURFACE_COLUMNS), ("psalm", TEXT_COLUMNS)):
    add(f"loaded_{_table}", _loaded(_table, _columns), _layers_sql(_table, _columns))


@query(f"select {', '.join(WORD_COLUMNS)} from corpus_word")
def loaded_corpus_word(spark: SparkSession, sf: str) -> DataFrame:
    return load_corpus(spark, f"{sf}/corpus_word.parquet", WORD_COLUMNS)


@query(f"with {_tokens_sql('lexeme')} select group_id, cast(n as int) as n, cast(seg_idx as int) as seg_idx, node_id from seg")
def acquired_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus that isn't where it is looked for is cloned once; here the clone is a link to the tables."""
    folder = new_path(spark, "acquired").removeprefix("file://")
    for _ in range(2):
        path = acquired(f"{folder}/none", folder, os.symlink, os.path.abspath(sf), "lexical_psalm.parquet")
    return segments(load_corpus(spark, path))


@query(f"with {_WORDS} select node, number, half_verse_node, lex, lex0, coalesce(freq_lex, -1) as freq_lex, g_cons, g_word, trailer from w")
def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    return words(table(spark, sf, "corpus_word")).select("node", "number", "half_verse_node", "lex", "lex0", F.coalesce("freq_lex", F.lit(-1)).alias("freq_lex"), "g_cons", "g_word", "trailer")


@query("select number, half_verse_node, cast(row_number() over (partition by number order by half_verse_node) - 1 as int) as place from (select distinct number, half_verse_node from corpus_word where half_verse_node is not null and number is not null)")
def segments_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    return containment(table(spark, sf, "corpus_word"))


@query("select half_verse_node, node, cast(row_number() over (partition by half_verse_node order by node) - 1 as int) as place from (select distinct half_verse_node, node from corpus_word where half_verse_node is not null and node is not null)")
def words_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    return containment(table(spark, sf, "corpus_word"), "half_verse_node", "node")


@query(f"""with {_WORDS}, s as (select number, half_verse_node, string_agg(coalesce(g_cons, '') || coalesce(trailer, ''), '' order by node) as c, string_agg(coalesce(g_word, '') || coalesce(trailer, ''), '' order by node) as t from w where half_verse_node is not null group by all)
select number, half_verse_node as node_id, trim(t, e' \\t\\n\\r\\u00a0') as text, trim(c, e' \\t\\n\\r\\u00a0') as text_consonantal, regexp_replace(trim(t, e' \\t\\n\\r\\u00a0'), {_MARKS_SQL}) as text_vocalized from s""")
def segment_text(spark: SparkSession, sf: str) -> DataFrame:
    return segment_texts(words(table(spark, sf, "corpus_word")))


@query(f"""with {_WORDS} select number, half_verse_node as node_id, cast(dense_rank() over (partition by number order by half_verse_node) - 1 as int) as seg_idx, cast(row_number() over (partition by number, half_verse_node order by node) - 1 as int) as tok_idx, lex as lexeme, g_cons as consonantal
from w where number is not null and half_verse_node is not null""")
def groups_from_words(spark: SparkSession, sf: str) -> DataFrame:
    nested = nested_from_words(words(table(spark, sf, "corpus_word")), "lexeme", "consonantal")
    rows = nested.select("number", F.posexplode(F.arrays_zip("nodes", "lexeme", "consonantal")).alias("seg_idx", "z"))
    return rows.select("number", F.col("z.nodes").alias("node_id"), "seg_idx", F.posexplode(F.arrays_zip("z.lexeme", "z.consonantal")).alias("tok_idx", "w")).select("number", "node_id", "seg_idx", "tok_idx", F.col("w.lexeme").alias("lexeme"), F.col("w.consonantal").alias("consonantal"))


@query(f"with l as (select * from (with {_tokens_sql('lexeme')} select * from tok)), f as (select * from (with {_tokens_sql('homograph')} select * from tok)) select group_id, node_id, cast(tok_idx as int) as tok_idx, l.value as lexeme, f.value as form from l join f using (group_id, node_id, tok_idx)")
def aligned_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Lexeme and form of each word, by its place."""
    nested = table(spark, sf, "lexical_psalm")
    keys = ["group_id", "node_id", "tok_idx"]
    return tokens(nested, "lexeme").select(*keys, F.col("value").alias("lexeme")).join(tokens(nested, "homograph").select(*keys, F.col("value").alias("form")), keys)


# --- text -------------------------------------------------------------------------------------------------------


@query(f"select distinct g_word, regexp_replace(g_word, {_MARKS_SQL}) as stripped from corpus_word")
def strip_marks_of_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_word").select("g_word").distinct().withColumn("stripped", strip_marks(F.col("g_word")))


_SPACE = r"[ \t\n\x{0b}\x{0c}\r\x{85}\p{Z}]+"


@query(rf"select distinct trailer, regexp_replace(regexp_replace(trailer, '^{_SPACE}', ''), '{_SPACE}$', '') as stripped from corpus_word")
def strip_space_of_trailers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_word").select("trailer").distinct().withColumn("stripped", strip_space(F.col("trailer")))


def _variant_sql(column: str) -> str:
    return f"""with g as (select number, first(half_verse_nodes order by loaded_at) as nodes, first({column} order by loaded_at) as t from psalm where number is not null group by number)
select number as group_id, cast(seg_idx as int) as seg_idx, node_id, text from (select number, unnest(range(len(nodes))) as seg_idx, unnest(nodes) as node_id, unnest(t) as text from g) where node_id is not null"""


def _variant(vocalized: bool, niqqud_only: bool):
    return lambda spark, sf: text_segments(table(spark, sf, "psalm"), vocalized, niqqud_only)


add("text_cantillation", _variant(True, False), _variant_sql("half_verses"))
add("text_vocalized", _variant(True, True), _variant_sql("half_verses_niqqud_only"))
add("text_consonantal", _variant(False, False), _variant_sql("half_verses_unvocalized"))

# --- positions, lags, orders ------------------------------------------------------------------------------------


@query(f"with {_SEG} select group_id, node_id, round({_T}, 6) as t, {_bin_sql(2)} as bin2, {_bin_sql(4)} as bin4, {_bin_sql(8)} as bin8 from seg")
def positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = position.with_position(segments(table(spark, sf, "lexical_psalm")))
    p, n = F.col("position"), F.col("n")
    return rows.select("group_id", "node_id", F.round(position.place(p, n), 6).alias("t"), *[position.place_bin(p, n, k).alias(f"bin{k}") for k in (2, 4, 8)])


@query(f"with {_SEG} select a.group_id, cast(a.seg_idx as int) as i, cast(b.seg_idx as int) as j, round((b.seg_idx - a.seg_idx) / (a.n - 1), 6) as lag, {_lag_sql(4)} as bin4 from seg a join seg b on a.group_id = b.group_id and a.seg_idx < b.seg_idx")
def pair_lags(spark: SparkSession, sf: str) -> DataFrame:
    own = segments(table(spark, sf, "lexical_psalm"))
    lags = recurrence.pair_lags(own).join(own.select("group_id", "n").distinct(), "group_id")
    return lags.select("group_id", "i", "j", F.round("lag", 6).alias("lag"), recurrence.lag_bin(F.col("j") - F.col("i"), F.col("n"), 4).alias("bin4"))


@query(f"{_tf_sql('homograph')}, {_COS} select group_id, cast(i as int) as i, cast(j as int) as j, round(cos, 6) as cos from c")
def pair_cosines(spark: SparkSession, sf: str) -> DataFrame:
    return recurrence.pair_cosines(prepared(spark, sf, "homograph").tf).select("group_id", "i", "j", F.round("cos", 6).alias("cos"))


_ORDER = f"ord as (select group_id, seed, seg_idx, row_number() over (partition by group_id, seed order by md5(group_id || ':' || seed || ':' || seg_idx), seg_idx) - 1 as position from seg, (select unnest([1, 2, 3]) as seed))"


@query(f"with {_SEG}, {_ORDER} select group_id, cast(seed as int) as seed, cast(position as int) as position, cast(seg_idx as int) as seg_idx from ord")
def shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled_order(segments(table(spark, sf, "lexical_psalm")), SEEDS)


def _with_seed(spark: SparkSession, sf: str) -> tuple[Prepared, DataFrame, DataFrame]:
    """Relations whose groups are (group, seed), so that all seeds are made in one job."""
    p = prepared(spark, sf, "homograph")
    order = shuffled_order(p.segments, SEEDS)
    key = F.concat_ws(":", F.col("group_id").cast("string"), F.col("seed").cast("string"))
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    tf = p.tf.select("*", seeds).withColumn("group_id", key)
    return Prepared(p.segments.select("*", seeds).withColumn("group_id", key), tf, p.dictionary), order.withColumn("group_id", key), tf


@query(f"{_tf_sql('homograph')}, {_ORDER}, x as (select seed, node_id, least(floor((position + CAST(0.5 AS DOUBLE)) / n * 4), 3) * size + idx as idx, w as val from tf join ord using (group_id, seg_idx)) select cast(seed as int) as seed, node_id, {_ROUND} from x")
def icf_position4_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    p, order, _ = _with_seed(spark, sf)
    long = position.pyramid(p.tf, 4, order)
    return long.select(F.split("group_id", ":")[1].cast("int").alias("seed"), "node_id", "idx", F.round("val", 6).alias("val"))


@query(f"""{_tf_sql('homograph')}, {_ORDER}, z as (select group_id, seed, idx, size, w, avg((position + CAST(0.5 AS DOUBLE)) / n) as t from tf join ord using (group_id, seg_idx) group by all),
h as (select group_id, seed, idx, w as val from z union all select group_id, seed, size + idx, w * (2 * t - 1) from z) select cast(seed as int) as seed, node_id, {_ROUND} from seg join h using (group_id)""")
def icf_position_mean_psalm_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    p, order, _ = _with_seed(spark, sf)
    long = p.segments.select("group_id", "seed", "node_id").join(_rounded(position.group_zoning(p.tf, order)), "group_id")
    return long.select(F.col("seed").cast("int").alias("seed"), "node_id", "idx", "val")


# --- dense vectors ----------------------------------------------------------------------------------------------

_FINITE = "len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0"


@query(f"select node_id, vector is not null and {_FINITE} as finite, case when vector is not null and {_FINITE} then round(sqrt(list_sum(list_transform(vector, lambda x: cast(x as double) * cast(x as double)))), 4) end as norm from part_0 where vector is null or len(vector) > 0")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part_0").where("vector is null or size(vector) > 0")
    finite = F.coalesce(all_finite(F.col("vector")), F.lit(False))
    return rows.select("node_id", finite.alias("finite"), F.when(finite, F.round(norm(F.col("vector")), 4)).alias("norm"))


_FLOAT = "round(cast(cast(val as float) as double), 4) + 0.0 as val"
_KEPT = "round(cast(cast(val as float) as double), 4) <> 0"


def _stored(column: str = "val"):
    """A stored single-precision value, in double precision and rounded."""
    return (F.round(F.col(column).cast("double"), 4) + F.lit(0.0)).alias("val")


@query(f"{_tf_sql('lexeme')}, x as (select node_id, idx, w as val from tf union all select node_id, -1, size from seg, (select max(size) as size from voc)) select node_id, cast(idx as bigint) as idx, {_FLOAT} from x where {_KEPT}")
def dense_icf(spark: SparkSession, sf: str) -> DataFrame:
    """Dense vectors, read back entry by entry; at -1 the vector's dimension."""
    p = prepared(spark, sf, "lexeme")
    size = p.dictionary.agg(F.max("size").alias("v")).first().v or 0
    dense = densify(build("icf", p), p.segments, int(size))
    entries = sparsify(dense).select("node_id", F.col("idx").cast("long").alias("idx"), _stored()).where("val <> 0")
    return entries.unionByName(dense.select("node_id", F.lit(-1).cast("long").alias("idx"), F.size("vector").cast("double").alias("val")))


@query(f"""with {_tokens_sql('lexeme')}, e as (select node_id, unnest(vector) as val, unnest(range(len(vector))) as idx from part_0 where vector is not null and {_FINITE})
select node_id, idx, round(cast(val as double), 4) + 0.0 as val from e join seg using (node_id)""")
def node_vectors_join(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings by group and place, joined to the segments' nodes, entry by entry."""
    own = segments(table(spark, sf, "lexical_psalm"))
    finite = table(spark, sf, "part_0").where(F.coalesce(all_finite(F.col("vector")), F.lit(False)))
    embedded = finite.join(own.select("node_id", "group_id", "seg_idx"), "node_id").select("group_id", "seg_idx", "vector")
    found = node_vectors(embedded, own).select("node_id", F.posexplode("vector").alias("idx", "val"))
    return found.select("node_id", F.col("idx").cast("long").alias("idx"), _stored())


_POOL_SQL = "select number, cast(i as int) as i, round(cast(x as double) / n, 6) + 0.0 as x, round(1 / n, 6) as y from (select number, i, x, sqrt(x * x + 1) as n from (select distinct on (number) number, len(half_verse_nodes) as i, CAST(len(half_verse_nodes) - 1 AS DOUBLE) as x from lexical_psalm where number is not null and half_verse_nodes is not null and len(half_verse_nodes) > 0))"


@query(_POOL_SQL)
def pooled_last_token(spark: SparkSession, sf: str) -> DataFrame:
    """A group's segments as a padded sequence of hidden states (place, 1), of which the last one under the mask is taken."""
    own = segments(table(spark, sf, "lexical_psalm")).select(F.col("group_id").alias("number"), "n").distinct().crossJoin(F.broadcast(segments(table(spark, sf, "lexical_psalm")).agg((F.max("n") + 1).alias("most"))))  # one row
    at = F.sequence(F.lit(0), F.col("most") - 1)
    batch = own.select("number", F.col("n").alias("i"), F.transform(at, lambda x: F.array(x.cast("double"), F.lit(1.0))).alias("hidden"), F.transform(at, lambda x: (x < F.col("n")).cast("int")).alias("mask"))
    return last_token_pooled(batch).select("number", "i", (F.round(F.col("vector")[0], 6) + F.lit(0.0)).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


@query("select cast(p.i as int) as position, cast(i.i as int) as i, round(cos(p.i / pow(10000, 2.0 * i.i / 64)), 6) as cos, round(sin(p.i / pow(10000, 2.0 * i.i / 64)), 6) as sin from range(64) p(i), range(32) i(i)")
def rotary(spark: SparkSession, sf: str) -> DataFrame:
    return rotary_tables(spark, 64, 64).select("position", "i", F.round("cos", 6).alias("cos"), F.round("sin", 6).alias("sin"))


# --- encoders ---------------------------------------------------------------------------------------------------


def _lengths():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


_TEXTS = _variant_sql("half_verses_unvocalized")


@query(f"select node_id, cast(length(coalesce(text, '')) as double) as first, CAST(1 AS DOUBLE) as second from ({_TEXTS})")
def encode_lengths(spark: SparkSession, sf: str) -> DataFrame:
    got = encode(text_segments(table(spark, sf, "psalm"), False, False), _lengths, dim=2, batch=96)
    return got.select("node_id", F.col("vector")[0].cast("double").alias("first"), F.col("vector")[1].cast("double").alias("second"))


class _Failing:
    """An encoder whose first two makings in a process give values that aren't finite."""

    made = 0

    def __init__(self):
        _Failing.made += 1
        self.bad = _Failing.made % 3 != 0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float("nan") if self.bad else float(len(t)), 1.0] for t in texts]


@query(f"select node_id, cast(length(coalesce(text, '')) as double) as first, CAST(1 AS DOUBLE) as second from ({_TEXTS})")
def encode_with_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts whose vectors aren't finite are made again with a new encoder."""
    got = encode(text_segments(table(spark, sf, "psalm"), False, False), _Failing, dim=2, attempts=3)
    return got.select("node_id", F.col("vector")[0].cast("double").alias("first"), F.col("vector")[1].cast("double").alias("second"))


class _Sentences:
    """Stands for the sentence library's model: the number of code points in the first place, 1 in the last, at length one if asked for."""

    def __init__(self, checkpoint: str, trust_remote_code: bool, device: str | None, **options):
        self.dim = BY_SLUG[next(s for s, c in CHECKPOINTS.items() if c == checkpoint)].dim

    def encode(self, texts: list[str], normalize_embeddings: bool) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        out[:, 0], out[:, -1] = [len(t) for t in texts], 1
        return out / np.linalg.norm(out, axis=1, keepdims=True) if normalize_embeddings else out


class _Hosted:
    """Stands for both kinds of provider's client: the number of code points in the first place of a vector, 1 in the last."""

    def __init__(self, api_key: str, base_url: str | None = None):
        self.embeddings = self

    def _vectors(self, model: str, texts: list[str]) -> list[list[float]]:
        dim = BY_SLUG[next(s for s, p in PROVIDERS.items() if p.model == model)].dim
        return [[float(len(t)), *[0.0] * (dim - 2), 1.0] for t in texts]

    def create(self, model: str, input: list[str], encoding_format: str) -> SimpleNamespace:  # noqa: A002
        return SimpleNamespace(data=[SimpleNamespace(embedding=v) for v in self._vectors(model, input)])

    def embed(self, model: str, input_type: str, texts: list[str], embedding_types: list[str]) -> SimpleNamespace:
        return SimpleNamespace(embeddings=SimpleNamespace(float_=self._vectors(model, texts)))


class _Tokenizer:
    """Code points as tokens, padded on the right."""

    def __call__(self, texts: list[str], padding: bool, truncation: bool, max_length: int, return_tensors: str) -> dict[str, np.ndarray]:
        cut = [t[:max_length] or "\0" for t in texts]
        ids, mask = np.zeros((2, len(cut), max(map(len, cut))), np.int64)
        for i, t in enumerate(cut):
            ids[i, : len(t)], mask[i, : len(t)] = [ord(c) for c in t], 1
        return {"input_ids": ids, "attention_mask": mask}


class _Bare:
    """A bare model whose hidden state of a token is (its code point, 1000)."""

    def to(self, device: str) -> _Bare:
        return self

    def eval(self) -> None:
        pass

    def __call__(self, input_ids: np.ndarray, attention_mask: np.ndarray) -> SimpleNamespace:
        return SimpleNamespace(last_hidden_state=np.stack([input_ids, np.full_like(input_ids, 1000)], axis=2).astype(np.float64))


_LAST = "case when text is null or text = '' then 0 else unicode(substring(text, least(length(text), 512), 1)) end"


@query(f"select node_id, round(c / sqrt(c * c + 1000000), 4) as first, round(1000 / sqrt(c * c + 1000000), 4) as second from (select node_id, cast({_LAST} as double) as c from ({_TEXTS}))")
def encode_last_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The path of models without the sentence library: tokenizer, bare model, pooling of the last token."""
    make = local_encoder("kalm-embedding", "cpu", load_tokenizer=lambda checkpoint, **options: _Tokenizer(), load_model=lambda checkpoint, **options: _Bare())
    got = encode(text_segments(table(spark, sf, "psalm"), False, False), make, dim=2)
    return got.select("node_id", F.round(F.col("vector")[0].cast("double"), 4).alias("first"), F.round(F.col("vector")[1].cast("double"), 4).alias("second"))


@query(f"select node_id, dim, cast(length(coalesce(text, '')) as double) as first, CAST(1 AS DOUBLE) as last from ({_TEXTS}), (select unnest([3072, 3072, 1536, 1024]) as dim)")
def fetched_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The texts' vectors from each of the four providers, whose clients are replaced here."""
    out = None
    for slug in PROVIDERS:
        get = fetcher(slug, _Hosted)
        rows = encode(text_segments(table(spark, sf, "psalm"), False, False), lambda get=get: lambda texts: get(texts, "key"), BY_SLUG[slug].dim, 500)
        own = rows.select("node_id", F.size("vector").alias("dim"), F.col("vector")[0].cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""select * from (values ('gemini', 'google/gemini-embedding-2', 100, 3072, 'OPENROUTER_API_KEY'), ('openai', 'openai/text-embedding-3-large', 100, 3072, 'OPENROUTER_API_KEY'),
('cohere', 'embed-v4.0', 96, 1536, 'COHERE_API_KEY'), ('voyage', 'voyageai/voyage-4', 100, 1024, 'OPENROUTER_API_KEY')) t(provider, model, batch, dim, key_variable)""")
def providers(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(s, p.model, BY_SLUG[s].batch, BY_SLUG[s].dim, KEY_VARIABLES[s]) for s, p in PROVIDERS.items()]
    return spark.createDataFrame(rows, "provider string, model string, batch int, dim int, key_variable string")


_LOADING_SQL = """with m as (select * from (values ('miqrabert', false, true, null, 1), ('alephbert', false, true, null, 1), ('neodictabert', false, true, null, 1), ('berel', false, true, null, 1),
('bge-multilingual-gemma2', false, true, 'float16', 1), ('qwen3-embedding', false, true, 'auto', 1), ('kalm-embedding', true, true, 'bfloat16', 1), ('llama-embed-nemotron', false, true, 'bfloat16', 1),
('harrier-oss-v1', true, false, 'auto', 1), ('f2llm-v2', false, false, 'bfloat16', 1), ('bge-m3', false, true, null, 1), ('gte-multilingual-base', false, true, null, 5), ('me5-large-instruct', false, true, null, 1)) t(model, plain, own_code, dtype, attempts)),
d as (select * from (values (null, false, false), (null, false, true), (null, true, false), (null, true, true), ('cuda:1', false, false)) t(asked, cuda, mps))
select model, asked, cuda, mps, plain, own_code, dtype, attempts, coalesce(asked, case when plain then case when cuda then 'cuda' when mps then 'mps' else 'cpu' end when model = 'gte-multilingual-base' then 'cpu' end) as device from m, d"""


@query(_LOADING_SQL)
def model_loading(spark: SparkSession, sf: str) -> DataFrame:
    """What each model is loaded with, by the device asked for and those that are there."""
    rows = []
    for slug in CHECKPOINTS:
        for asked, cuda, mps in ((None, False, False), (None, False, True), (None, True, False), (None, True, True), ("cuda:1", False, False)):
            how = loading(slug, asked, None, cuda, mps)
            rows.append((slug, asked, cuda, mps, how.plain, how.own_code, how.dtype, how.attempts, how.device))
    return spark.createDataFrame(rows, "model string, asked string, cuda boolean, mps boolean, plain boolean, own_code boolean, dtype string, attempts int, device string")


@query(f"with {_SEG} select group_id, node_id, cast(floor(seg_idx / 96) as int) as batch from seg")
def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batch_numbers(segments(table(spark, sf, "lexical_psalm")), 96, "seg_idx").select("group_id", "node_id", "batch")


_SPANS_SQL = "coalesce(sum(m) over (order by group_id rows between unbounded preceding and 1 preceding), 0)"


@query(f"with {_SEG} select group_id, cast({_SPANS_SQL} as bigint) as start, cast(sum(m) over (order by group_id) as bigint) as \"end\" from (select group_id, count(*) as m from seg group by group_id)")
def group_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans(segments(table(spark, sf, "lexical_psalm")))


@query(f"with {_SEG} select group_id, cast(row_number() over (order by group_id) - 1 as bigint) as rank, cast({_SPANS_SQL} as bigint) as start from (select group_id, count(*) as m from seg group by group_id)")
def groups_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return group_order(segments(table(spark, sf, "lexical_psalm"))).select("group_id", "rank", "start")


# --- strict weights, words out of the vocabulary, numpy's permutation ---------------------------------------------------


@query(f"""with {_tokens_sql('lexeme')}, t as (select count(*) as total from tok), f as (select value, count(*) as f from tok group by value),
voc as (select value, row_number() over (order by value) - 1 as idx from f)
select node_id, cast(idx as bigint) as idx, round(ln((total + 1) / (f + 1)) + 1, 6) as val from (select distinct node_id, value from tok) join f using (value) join voc using (value), t""")
def strict_icf(spark: SparkSession, sf: str) -> DataFrame:
    """Weights counted over the groups themselves, so that every value must have one: a missing one would be an error."""
    nested = table(spark, sf, "lexical_psalm")
    own = tokens(nested, "lexeme")
    weights = freq.icf_weights(own.groupBy("value").agg(F.count("*").alias("f")), own.agg(F.count("*").alias("total")))
    return build("icf", prepare(nested, "lexeme", weights=weights, strict=True)).select("node_id", "idx", F.round("val", 6).alias("val"))


@query(f"""with {_tokens_sql('homograph', _SCOPE)}, o as (select * from tok), own as (select value, row_number() over (order by value) - 1 as idx from (select distinct value from o)),
a as (select * from (with {_tokens_sql('homograph')} select * from tok)), c as (select node_id, count(idx) as kept, count(*) - count(idx) as dropped, count(distinct idx) as entries, sum(idx) as places from a left join own using (value) group by node_id),
s as (select * from (with {_tokens_sql('homograph')} select * from seg))
select s.node_id, coalesce(kept, 0) as kept, coalesce(dropped, 0) as dropped, coalesce(entries, 0) as entries, cast(coalesce(places, 0) as bigint) as places from s left join c using (node_id)""")
def out_of_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """All groups over one book's vocabulary: other words are left out, their segments stay."""
    nested = table(spark, sf, "lexical_psalm")
    own = dictionary(vocabulary(tokens(in_scope(nested, BOOK), "homograph")))
    every = tokens(nested, "homograph")
    tf = vectors.term_frequency(every, own).groupBy("node_id").agg(F.sum("tf").alias("kept"), F.count("*").alias("entries"), F.sum(F.col("tf") * F.col("idx")).alias("places"))
    all_ = every.groupBy("node_id").agg(F.count("*").alias("n"))
    rows = segments(nested).select("node_id").join(all_, "node_id", "left").join(tf, "node_id", "left").fillna(0)
    return rows.select("node_id", "kept", (F.col("n") - F.col("kept")).alias("dropped"), "entries", "places")


@query()
def shuffle_order_of_numpy(spark: SparkSession, sf: str) -> DataFrame:
    """The generator's own permutation of each group, of the first seed; SQL has no such generator, a test compares it with numpy."""
    return numpy_order(segments(table(spark, sf, "lexical_psalm")), 1)


# --- plans, commands and the catalog -------------------------------------------------------------------------------

_UNITS_SQL = ", ".join(f"'{unit_name(u)}'" for u in UNITS)
_NAMES_SQL = ", ".join(f"'{c}'" for c in CONSTRUCTIONS)
_PLAN_SQL = f"""select unit, construction, unit || '_' || construction as dataset,
'type=lexical/unit=' || case when unit like 'word%' then 'word/text=' || unit[6:] else unit end || '/construction=' || construction as leaf
from (select unnest([{_UNITS_SQL}]) as unit), (select unnest([{_NAMES_SQL}]) as construction)"""


@query(_PLAN_SQL)
def dataset_plan(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.lexical_plan(spark)


def _command(spark: SparkSession, root: str, sf: str, what: str, groups: str, *options: str, **given) -> list[str]:
    """Run the command line over the tables; values without a frequency weigh like frequency 0."""
    return pipeline.main([what, "--groups", f"{sf}/{groups}.parquet", "--words", f"{sf}/corpus_word.parquet", "--output-root", root, "--lenient", *options], **given)


def _written(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, node_id, idx, val) of what was written, entry by entry."""
    every = read_datasets(spark, root, type="semantic")
    if every is None:
        entries = read_entries(spark, root, lambda v: "_".join(v[k] for k in ("unit", "text", "construction") if k in v))
        return entries.select("dataset", "node_id", "idx", _to_four(F.col("val").cast("double")).alias("val")).where("val <> 0")
    name = F.concat_ws("_", F.coalesce("unit", F.col("type")), "model", "text", "construction")
    return every.select(name.alias("dataset"), "node_id", F.posexplode("vector").alias("idx", "val")).where("val <> 0").select("dataset", "node_id", F.col("idx").cast("long").alias("idx"), _stored()).where("val <> 0")


def _to_four(x: Column) -> Column:
    """round(x, 4) in plain arithmetic, which is exact for single-precision values of moderate size: no such value times 10,000 lies closer to a half than doubles tell apart."""
    near = F.floor(F.abs(x) * 10000 + 0.5) / 10000
    return F.when(F.abs(x) < 1e6, F.when(x < 0, -near).otherwise(near) + F.lit(0.0)).otherwise(F.round(x, 4))


def _written_sql(parts: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as dataset, node_id, cast(idx as bigint) as idx, {_FLOAT} from ({sql}) where {_KEPT}" for name, sql in parts.items())


#: One construction of each kind; all nineteen are registered as queries of their own.
_SOME = ("tf_icf", "icf_spacing4_psalm", "icf_position_mean")


def _exact(sql: str) -> str:
    """A construction's SQL with values as they are."""
    return sql.replace(_ROUND, "idx, val").replace("round(ln(1 + tf) * w, 6) as val", "ln(1 + tf) * w as val")


@query(_written_sql({f"{u}_{c}": _exact(construction_sql(c, u)) for u in LEXICAL_UNITS for c in _SOME}))
def command_lexical(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "datasets")
    _command(spark, root, sf, "lexical", "lexical_psalm", "--constructions", *_SOME)
    return _written(spark, root)


@query(_written_sql({f"word_{u}_{c}": _exact(construction_sql(c, u)) for u in UNITS if u not in LEXICAL_UNITS for c in _SOME}))
def command_surface(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "datasets")
    _command(spark, root, sf, "surface", "surface_psalm", "--constructions", *_SOME)
    return _written(spark, root)


def _shuffled_sql(sql: str) -> dict[str, str]:
    return {f"homograph_{sql}0{s}": f"select * from ({_exact(ORACLE_SQL[sql])}) where seed = {s}" for s in (1, 2)}


@query(_written_sql(_shuffled_sql("icf_position_mean_psalm_shuffle")))
def command_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "datasets")
    _command(spark, root, sf, "shuffle", "lexical_psalm", "--n-shuffles", "2", "--order", "hash")
    return _written(spark, root)


@query(_written_sql(_shuffled_sql("icf_position4_shuffle")))
def command_shuffle_segments(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "datasets")
    _command(spark, root, sf, "shuffle-segments", "lexical_psalm", "--n-shuffles", "2", "--order", "hash")
    return _written(spark, root)


_TEXT_COLUMN = {"consonantal": "half_verses_unvocalized", "vocalized": "half_verses_niqqud_only", "cantillation": "half_verses"}


def _semantic_sql(model: str, dim: int, unit: bool, *texts: str) -> dict[str, str]:
    n = "sqrt(c * c + 1)" if unit else "CAST(1 AS DOUBLE)"
    counted = "select node_id, cast(length(coalesce(text, '')) as double) as c from ({})"
    return {f"semantic_{model}_{t}": " union all ".join(f"select node_id, {i} as idx, {v} / {n} as val from ({counted.format(_variant_sql(_TEXT_COLUMN[t]))})" for i, v in ((0, "c"), (dim - 1, "1"))) for t in texts}


def _semantic_command(*options: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = new_path(spark, "datasets")
        encoders = {s: local_encoder(s, factory=_Sentences) for s in ("berel", "bge-m3", "f2llm-v2")}
        fetchers = {s: fetcher(s, _Hosted) for s in ("cohere", "voyage")}
        _command(spark, root, sf, *options[:1], "psalm", *options[1:], encoders=encoders, fetchers=fetchers, env=dict.fromkeys(KEY_VARIABLES.values(), "key"))
        return _written(spark, root)

    return run


_ALL_TEXTS = tuple(_TEXT_COLUMN)
add("command_semantic", _semantic_command("semantic", "--models", "berel", "voyage"), _written_sql(_semantic_sql("berel", 768, True, "consonantal") | _semantic_sql("voyage_4", 1024, False, *_ALL_TEXTS)))
add("command_semantic_variation", _semantic_command("semantic", "--models", "berel", "bge-m3", "cohere", "--variation", "vocalized"), _written_sql(_semantic_sql("bge_m3", 1024, True, "vocalized") | _semantic_sql("cohere_embed_v4", 1536, False, "vocalized")))


def _large_command(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "datasets")
    pipeline.main(["large", "--groups", f"{sf}/psalm.parquet", "--output-root", root, "--choice", "f2llm", "--variation", "consonantal"], encoders={"f2llm-v2": local_encoder("f2llm-v2", factory=_Sentences)})
    return _written(spark, root)


add("command_large", _large_command, _written_sql(_semantic_sql("f2llm_v2_14b", 5120, True, "consonantal")))


@query(f"with {_SEG} select node_id, row_number() over (order by node_id) - 1 as place from seg")
def written_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's place in the file of a written dataset."""
    root = new_path(spark, "datasets")
    p = prepare(table(spark, sf, "lexical_psalm"), "lexeme")
    leaf = pipeline.write_dataset(p.segments.select("node_id", F.array(F.col("seg_idx").cast("float")).alias("vector")), f"{root}/type=lexical/unit=lexeme/construction=place", "places")
    return spark.read.parquet(leaf).select("node_id", F.col("_metadata.row_index").alias("place"))


def _two_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The leaves after a first run with one construction, and after a second with two."""
    root, got = new_path(spark, "datasets"), []
    for some in (["icf_spacing2"], ["icf_spacing2", "icf_spacing8"]):
        _command(spark, root, sf, "lexical", "lexical_psalm", "--constructions", *some)
        got.append(listing(spark, root))
    return got[0], got[1]


@query("select unnest(['type=lexical/unit=homograph/construction=icf_spacing8', 'type=lexical/unit=lexeme/construction=icf_spacing8']) as leaf")
def new_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return new_leaves(*_two_runs(spark, sf))


@query(f"select * from ({_PLAN_SQL}) where not (unit in ('lexeme', 'homograph') and construction in ('icf_spacing2', 'icf_spacing8'))")
def dataset_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """The plan without what two runs have written."""
    return not_written(pipeline.lexical_plan(spark), _two_runs(spark, sf)[1], ["leaf"])


_MODELS_SQL = """with m as (select * from (values ('miqrabert', 'miqrabert', 768, true), ('alephbert', 'alephbert', 768, true), ('neodictabert', 'neodictabert', 768, true), ('berel', 'berel', 768, true),
('bge-multilingual-gemma2', 'bge_multilingual_gemma2', 3584, false), ('qwen3-embedding', 'qwen3_embedding_8b', 4096, false), ('kalm-embedding', 'kalm_embedding_gemma3_12b_2511', 3840, false),
('llama-embed-nemotron', 'llama_embed_nemotron_8b', 4096, false), ('harrier-oss-v1', 'harrier_oss_v1_27b', 5376, false), ('f2llm-v2', 'f2llm_v2_14b', 5120, false), ('bge-m3', 'bge_m3', 1024, false),
('gte-multilingual-base', 'gte_multilingual_base', 768, false), ('me5-large-instruct', 'me5_large_instruct', 1024, false), ('gemini', 'gemini_embedding_2', 3072, false),
('openai', 'openai_text_embedding_3_large', 3072, false), ('cohere', 'cohere_embed_v4', 1536, false), ('voyage', 'voyage_4', 1024, false)) t(model, d, dim, strips)),
v as (select * from (values ('consonantal', 'consonants only'), ('vocalized', 'with vowel points'), ('cantillation', 'with vowel points and accents')) t(variation, about))
select model, variation, 'semantic_' || d || '_' || variation as dataset, dim, 'type=semantic/model=' || d || '/text=' || variation as leaf,
d || ' embeddings of each segment, ' || about || '; node_id int32, vector float32[' || dim || ']' as description from m, v where not strips or variation = 'consonantal'"""


@query(_MODELS_SQL)
def model_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return model_variations(spark)


@query("""with a as (select * from (values ('bge', 'bge-multilingual-gemma2', 'float16'), ('qwen3', 'qwen3-embedding', 'auto'), ('kalm', 'kalm-embedding', 'bfloat16'), ('llama-nemotron', 'llama-embed-nemotron', 'bfloat16'),
('harrier', 'harrier-oss-v1', 'auto'), ('f2llm', 'f2llm-v2', 'bfloat16')) t(choice, model, dtype)) select choice, model, dtype from a union all select null, model, dtype from a""")
def large_model_choices(spark: SparkSession, sf: str) -> DataFrame:
    return large_models(spark)
