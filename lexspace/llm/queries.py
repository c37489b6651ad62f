"""Registered queries of the training-data operators and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspace.llm.clusters import clusters
from lexspace.llm.collision import nearest
from lexspace.llm.cooccurrence import together
from lexspace.llm.deliveries import first_deliveries
from lexspace.llm.distinctive import association, most_distinctive
from lexspace.llm.langid import language_lines
from lexspace.llm.leakage import leaked_items
from lexspace.llm.mixing import mixture, reached_shares
from lexspace.llm.neardup import expanded, groups, similar_pairs
from lexspace.llm.pairs import pairs_within
from lexspace.llm.spans import END, char_body, shared_spans, token_body
from lexspace.llm.termfreq import marked_terms
from lexspace.storage import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a run of a test passage, and the items."""
    found = leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_item"))
    return found.select("doc_id", F.col("item_id").cast("int").alias("item_id"))


@query
def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each test item: in how many documents it stands, the longest run and whether it stands there in full."""
    found = leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_item"))
    return found.groupBy(F.col("item_id").cast("int").alias("item_id")).agg(
        F.count("*").alias("documents"),
        F.max("longest_run").alias("longest_run"),
        F.sum((F.col("words_covered") == F.col("passage_words")).cast("long")).alias("in_full"),
    )


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents whose label is wrong or missing or which mix languages."""
    wrong = language_lines(table(spark, sf, "documents"), only_wrong=True)
    return wrong.select("doc_id", "line_no", "lang").distinct()


@query
def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's language (that of most of its countable lines), its share of them, the mean confidence, and how many lines are rejected as none of the languages."""
    lines = language_lines(table(spark, sf, "documents"))
    by = lines.groupBy("doc_id", "lang", "named").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count_if("rejected").alias("r"))
    return by.groupBy("doc_id", "named").agg(
        F.max_by("lang", F.struct("n", "lang")).alias("lang"),
        F.max("n").alias("lines_in_it"),
        F.sum("n").alias("lines"),
        F.sum("r").alias("rejected_lines"),
        (F.sum("c") / F.sum("n")).alias("confidence"),
        (F.count("*") > 1).alias("mixed"),
    )


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each probe node with each of its five most similar nodes."""
    probes = table(spark, sf, "probe_node").where("task = 'neighbours'").select("node_id")
    found = nearest(table(spark, sf, "part_0"), probes, k=5)
    return found.select(F.least("query", "neighbour").cast("int").alias("node_a"), F.greatest("query", "neighbour").cast("int").alias("node_b")).distinct()


@query
def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar nodes of every node whose id is divisible by 20, against all nodes."""
    vectors = table(spark, sf, "part_0")
    found = nearest(vectors, vectors.where("node_id % 20 = 0").select("node_id"), k=5)
    return found.select(F.col("query").cast("int").alias("node_id"), F.col("neighbour").cast("int").alias("neighbour_id"), "rank", F.round(F.col("cosine").cast("double"), 3).alias("cosine"))  # reckoned in single precision


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of probe nodes in one cluster."""
    probes = table(spark, sf, "probe_node").where("task = 'clusters'").select(F.col("node_id").cast("long").alias("key")).distinct()
    own = clusters(table(spark, sf, "part_0"), typical=0).where("cluster is not null").join(probes, "key").select("cluster", F.col("key").cast("int").alias("node"))
    return pairs_within(own, ["cluster"], "node", "node_a", "node_b").select("node_a", "node_b")


@query
def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's cluster, the cluster's size and the most typical nodes' ranks."""
    found = clusters(table(spark, sf, "part_0"))
    return found.select(F.col("key").cast("int").alias("node_id"), "cluster", "size", "medoid_rank")


SPAN_RUNS = {"unvocalized": ("char", 60), "lexemes": ("token", 12)}


def _flat(nested: Column) -> Column:
    """The words of all half-verses; null half-verses and words are left out."""
    return F.filter(F.flatten(F.filter(nested, lambda x: x.isNotNull())), lambda x: x.isNotNull())


def _span_records(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "psalm").select(F.lit("unvocalized").alias("field"), "number", char_body(F.array_join("half_verses_unvocalized", " ")).alias("body"))
    lexemes = table(spark, sf, "lexical_psalm").select(F.lit("lexemes").alias("field"), "number", token_body(_flat(F.col("half_verse_lexemes"))).alias("body"))
    return text.unionByName(lexemes)


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of psalms with a long common passage."""
    found = shared_spans(_span_records(spark, sf), SPAN_RUNS)
    return found.select("field", F.col("number_a").cast("int").alias("number_a"), F.col("number_b").cast("int").alias("number_b")).withColumnRenamed("field", "field_name")


@query
def p1_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Of each psalm: the symbols that stand elsewhere too, all its symbols, and the share; 0 where nothing is shared."""
    records = _span_records(spark, sf)
    pieces = shared_spans(records, SPAN_RUNS, pairs=False)
    before = Window.partitionBy("field", "number").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reached", "start")))
    by = pieces.withColumn("reached", F.max("stop").over(before)).groupBy("field", F.col("number").cast("int").alias("number"))
    tokens = F.length("body") - F.length(F.replace("body", F.lit(END), F.lit("")))
    size = F.when(F.col("field").isin([f for f, (unit, _) in SPAN_RUNS.items() if unit == "char"]), F.length("body")).otherwise(tokens)
    sizes = records.where("number is not null").groupBy("field", "number").agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("total"))
    every = sizes.join(by.agg(F.sum(fresh).alias("shared")), ["field", "number"], "left")
    shared = F.coalesce("shared", F.lit(0))
    share = F.when(F.col("total") > 0, shared / F.col("total")).otherwise(F.lit(0.0))
    return every.select(F.col("field").alias("field_name"), "number", shared.cast("long").alias("shared"), "total", share.alias("share"))


BAG_UNITS = {"unvocalized": "space", "forms": "token"}


def _bag_records(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "psalm").select(F.lit("unvocalized").alias("field"), "number", F.array_join("half_verses_unvocalized", " ").alias("body"))
    forms = table(spark, sf, "lexical_psalm").select(F.lit("forms").alias("field"), "number", token_body(_flat(F.col("half_verse_forms"))).alias("body"))
    return text.unionByName(forms)


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of psalms that share most of their words."""
    found = expanded(*similar_pairs(_bag_records(spark, sf), BAG_UNITS))
    return found.select(F.col("field").alias("field_name"), F.col("number_a").cast("int").alias("number_a"), F.col("number_b").cast("int").alias("number_b"))


@query
def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each psalm's class of equal bags, its number of links and its group."""
    found = groups(*similar_pairs(_bag_records(spark, sf), BAG_UNITS))
    return found.select(F.col("field").alias("field_name"), F.col("number").cast("int").alias("number"), F.col("class_id").cast("int").alias("class_id"), "links", F.col("group_id").cast("int").alias("group_id"))


@query
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed collection: every drawn block with its shard, its tokens and the documents they are of."""
    return mixture(table(spark, sf, "documents"), table(spark, sf, "source_weight"))


@query
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the tokens that each source has reached."""
    weights = table(spark, sf, "source_weight")
    return reached_shares(mixture(table(spark, sf, "documents"), weights), weights)


def _word_records(spark: SparkSession, sf: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(field, number, words) of the nested columns: field -> (table, column)."""
    out = None
    for field, (name, column) in fields.items():
        own = table(spark, sf, name).select(F.lit(field).alias("field"), "number", _flat(F.col(column)).alias("words"))
        out = own if out is None else out.unionByName(own)
    return out


FREQUENCY_FIELDS = {"lexemes": ("lexical_psalm", "half_verse_lexemes"), "vocalized": ("surface_psalm", "half_verse_vocalized"), "cantillation": ("surface_psalm", "half_verse_cantillation")}
DISTINCTIVE_FIELDS = {"lexemes": ("lexical_psalm", "half_verse_lexemes"), "forms": ("lexical_psalm", "half_verse_forms"), "consonantal": ("surface_psalm", "half_verse_consonantal")}


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that are too rare or too common."""
    found = marked_terms(_word_records(spark, sf, FREQUENCY_FIELDS)).where("mark is not null")
    return found.select(F.col("field").alias("field_name"), "term", "mark")


@query
def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Each term's occurrences, psalms and mark."""
    return marked_terms(_word_records(spark, sf, FREQUENCY_FIELDS)).withColumnRenamed("field", "field_name")


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each psalm's most characteristic terms."""
    found = most_distinctive(_word_records(spark, sf, DISTINCTIVE_FIELDS))
    return found.select(F.col("field").alias("field_name"), F.col("number").cast("int").alias("number"), "term")


@query
def p3_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How characteristic every term of every psalm is."""
    found = association(_word_records(spark, sf, DISTINCTIVE_FIELDS))
    return found.select(F.col("field").alias("field_name"), F.col("number").cast("int").alias("number"), "term", "tf", "df", F.round("ppmi", 6).alias("ppmi"), F.round("tf_icf", 6).alias("tf_icf"))


def _half_verses(spark: SparkSession, sf: str) -> DataFrame:
    """(items): the lexemes of each half-verse, deliveries of a psalm counted once."""
    one = first_deliveries(table(spark, sf, "lexical_psalm"), ["number"], "half_verse_lexemes")
    return one.select(F.explode("half_verse_lexemes").alias("items")).where("items is not null")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lexemes that stand together far more often than chance would have it."""
    found = together(_half_verses(spark, sf), least=5).where("lift >= 6")
    return found.select(F.col("item_a").alias("lexeme_a"), F.col("item_b").alias("lexeme_b"))


@query
def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of lexemes that stand together, with their counts and lift."""
    found = together(_half_verses(spark, sf))
    return found.select(F.col("item_a").alias("lexeme_a"), F.col("item_b").alias("lexeme_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _flat_sql(column: str, name: str) -> str:
    return f"select number, list_filter(flatten(list_filter({column}, lambda x: x is not null)), lambda x: x is not null) as words from (select number, min({column}) as {column} from {name} where number is not null group by number)"


def _word_sql(fields: dict[str, tuple[str, str]]) -> str:
    return " union all ".join(f"select '{f}' as field, number, words from ({_flat_sql(c, t)})" for f, (t, c) in fields.items())


_TERMS_SQL = f"""
with r as ({_word_sql(FREQUENCY_FIELDS)}), s as (select field, count(*) as n from r group by field),
t as (select field, number, unnest(words) as term from r),
c as (select field, term, count(*) as occurrences, count(distinct number) as records from t where term <> '' group by field, term)
select c.field as field_name, term, occurrences, records, case when records <= 2 then 'rare' when records > n * 0.4 then 'common' end as mark from c join s using (field)
"""
ORACLE_SQL["p2_terms"] = _TERMS_SQL
ORACLE_SQL["p2_found"] = f"select field_name, term, mark from ({_TERMS_SQL}) where mark is not null"
_SCORES_SQL = f"""
with r as ({_word_sql(DISTINCTIVE_FIELDS)}), s as (select field, count(*) as n from r group by field),
j as (select field, number, term, count(*) as tf from (select field, number, unnest(words) as term from r) group by all),
t as (select field, term, sum(tf) as occurrences, count(*) as df from j group by all),
z as (select field, number, sum(tf) as size from j group by all),
c as (select field, sum(pow(size, CAST(0.75 AS DOUBLE))) as context from z group by field)
select j.field as field_name, number, term, tf, df, greatest(CAST(0 AS DOUBLE), ln(tf * context / (occurrences * pow(size, CAST(0.75 AS DOUBLE))))) as ppmi, ln(1 + tf) * (ln((n + 1) / (df + 1)) + 1) as tf_icf
from j join t using (field, term) join z using (field, number) join c using (field) join s using (field)
"""
ORACLE_SQL["p3_scores"] = f"select field_name, number, term, tf, df, round(ppmi, 6) as ppmi, round(tf_icf, 6) as tf_icf from ({_SCORES_SQL})"
ORACLE_SQL["p3_found"] = f"with x as (select * from ({_SCORES_SQL}) where df >= 2) select field_name, number, term from x join (select field_name, number, max(tf_icf) as top from x group by all) using (field_name, number) where tf_icf >= top - 1e-9"
_PAIRS_SQL = """
with p as (select number, min(half_verse_lexemes) as h from lexical_psalm where number is not null group by number),
b as (select row_number() over () as id, items from (select unnest(h) as items from p)),
i as (select distinct id, item from (select id, unnest(items) as item from b) where item is not null),
c as (select item, count(*) as c from i group by item), t as (select count(distinct id) as h from i),
n as (select x.item as a, y.item as b, count(*) as n from i x join i y on x.id = y.id and x.item < y.item group by all)
select a as lexeme_a, b as lexeme_b, n, ca.c as n_a, cb.c as n_b, n * h / (ca.c * cb.c) as lift from n join c ca on a = ca.item join c cb on b = cb.item, t
"""
ORACLE_SQL["p7_pairs"] = f"select lexeme_a, lexeme_b, n, n_a, n_b, round(lift, 6) as lift from ({_PAIRS_SQL})"
ORACLE_SQL["p7_found"] = f"select lexeme_a, lexeme_b from ({_PAIRS_SQL}) where n >= 5 and lift >= 6"

ORACLE_SQL["p1_found"] = """
with u as (select distinct number, array_to_string(list_filter(half_verses_unvocalized, lambda x: x is not null), ' ') as t from psalm where number is not null),
ug as (select distinct number, substring(t, cast(i as bigint), 60) as g from (select number, t, unnest(range(1, length(t) - 58)) as i from u where length(t) >= 60)),
l as (select distinct number, list_filter(flatten(list_filter(half_verse_lexemes, lambda x: x is not null)), lambda x: x is not null) as w from lexical_psalm where number is not null),
lg as (select distinct number, w[i:i + 11] as g from (select number, w, unnest(range(1, len(w) - 10)) as i from l where len(w) >= 12))
select distinct 'unvocalized' as field_name, a.number as number_a, b.number as number_b from ug a join ug b on a.g = b.g and a.number < b.number
union all select distinct 'lexemes', a.number, b.number from lg a join lg b on a.g = b.g and a.number < b.number
"""
ORACLE_SQL["p1_shared"] = """
with u as (select 'unvocalized' as field_name, number, max(array_to_string(list_filter(half_verses_unvocalized, lambda x: x is not null), ' ')) as t from psalm where number is not null group by number),
l as (select 'lexemes' as field_name, number, max(list_filter(flatten(list_filter(half_verse_lexemes, lambda x: x is not null)), lambda x: x is not null)) as w from lexical_psalm where number is not null group by number),
s as (select field_name, number, cast(coalesce(length(t), 0) as bigint) as total from u union all select field_name, number, cast(coalesce(len(w), 0) as bigint) from l),
g as (select field_name, number, i, 60 as run, substring(t, cast(i as bigint), 60) as g from (select field_name, number, t, unnest(range(1, length(t) - 58)) as i from u where length(t) >= 60)
 union all select field_name, number, i, 12, array_to_string(list_transform(w[i:i + 11], lambda x: replace(replace(x, '~', '~0'), '|', '~1')), '|') from (select field_name, number, w, unnest(range(1, len(w) - 10)) as i from l where len(w) >= 12)),
k as (select field_name, g from g group by field_name, g having min(number) < max(number)),
c as (select field_name, number, sum(least(run, coalesce(n - i, run))) as shared from (select field_name, number, i, run, lead(i) over (partition by field_name, number order by i) as n from g join k using (field_name, g)) group by field_name, number)
select field_name, number, cast(coalesce(shared, 0) as bigint) as shared, total, case when total > 0 then coalesce(shared, 0) / total else CAST(0 AS DOUBLE) end as share from s left join c using (field_name, number)
"""
ORACLE_SQL["p5_found"] = """
with v as (select node_id, min(vector) as v from part_0 where node_id is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by node_id),
q as (select distinct node_id from probe_node where task = 'neighbours'),
s as (select a.node_id as x, b.node_id as y, list_cosine_similarity(cast(a.v as double[]), cast(b.v as double[])) as c from v a join q using (node_id) join v b on a.node_id <> b.node_id),
r as (select x, y, row_number() over (partition by x order by c desc, y) as k from s)
select distinct least(x, y) as node_a, greatest(x, y) as node_b from r where k <= 5
"""
ORACLE_SQL["p6_found"] = r"""
with u as (select distinct 'unvocalized' as field, number, list_filter(regexp_split_to_array(array_to_string(list_filter(half_verses_unvocalized, lambda x: x is not null), ' '), '[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+'), lambda x: x <> '') as w from psalm where number is not null
 union all select distinct 'forms', number, list_filter(flatten(list_filter(half_verse_forms, lambda x: x is not null)), lambda x: x is not null) from lexical_psalm where number is not null),
s as (select field, number, len(w) as n from u), t as (select field, number, word, count(*) as c from (select field, number, unnest(w) as word from u) group by all),
m as (select a.field, a.number as x, b.number as y, sum(least(a.c, b.c)) as i from t a join t b on a.field = b.field and a.word = b.word and a.number < b.number group by all)
select m.field as field_name, x as number_a, y as number_b from m join s a on a.field = m.field and a.number = x join s b on b.field = m.field and b.number = y where 10 * i >= 7 * (a.n + b.n - i)
"""

ORACLE_SQL["p5_neighbours"] = """
with v as (select node_id, min(vector) as v from part_0 where node_id is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by node_id),
s as (select a.node_id as x, b.node_id as y, list_cosine_similarity(cast(a.v as double[]), cast(b.v as double[])) as c from v a join v b on a.node_id <> b.node_id where a.node_id % 20 = 0),
r as (select x, y, c, row_number() over (partition by x order by c desc, y) as k from s)
select x as node_id, y as neighbour_id, cast(k as int) as rank, round(c, 3) as cosine from r where k <= 5
"""
_BAGS_SQL = ORACLE_SQL["p6_found"][: ORACLE_SQL["p6_found"].rindex("select m.field")]
ORACLE_SQL["p6_groups"] = _BAGS_SQL.replace("with u as", "with recursive u as", 1) + """, p as (select m.field, x, y from m join s a on a.field = m.field and a.number = x join s b on b.field = m.field and b.number = y where 10 * i >= 7 * (a.n + b.n - i)),
d as (select field, number, min(z) as class_id from (select t.field, t.number, first(t.number) over (partition by t.field, t.bag order by t.number) as z from (select field, number, list_sort(w) as bag from u where len(w) > 0) t) group by all),
l as (select distinct p.field, a.class_id as v, b.class_id as w from p join d a on a.field = p.field and a.number = x join d b on b.field = p.field and b.number = y where a.class_id <> b.class_id),
e as (select field, v, w from l union select field, w, v from l),
r as (select field, class_id as v, class_id as g from d union select e.field, e.w, r.g from r join e on e.field = r.field and e.v = r.v),
k as (select field, v, min(g) as g from r group by all), n as (select field, v, count(*) as links from e group by all)
select d.field as field_name, d.number, d.class_id, coalesce(n.links, 0) as links, k.g as group_id from d left join n on n.field = d.field and n.v = d.class_id join k on k.field = d.field and k.v = d.class_id
"""
_WORDS_SQL = r"regexp_extract_all(regexp_replace(lower(strip_accents(regexp_replace({}, '[\p{{M}}\p{{Cf}}]', '', 'g'))), '[\p{{M}}\p{{Cf}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"
_RUNS_SQL = f"""
with d as (select doc_id, {_WORDS_SQL.format("text")} as w from documents where doc_id is not null and text is not null),
i as (select item_id, {_WORDS_SQL.format("passage")} as w from eval_item where item_id is not null and passage is not null),
dg as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)),
ig as (select item_id, k, len(w) as words, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)),
f as (select distinct doc_id, item_id, k, words from dg join ig using (g))
"""
ORACLE_SQL["p8_found"] = f"{_RUNS_SQL} select distinct doc_id, item_id from f"
ORACLE_SQL["p8_leaks"] = f"""{_RUNS_SQL}, s as (select doc_id, item_id, words, k, k - row_number() over (partition by doc_id, item_id order by k) as streak, least(12, coalesce(k - lag(k) over (partition by doc_id, item_id order by k), 12)) as fresh from f),
r as (select doc_id, item_id, any_value(words) as words, sum(fresh) as covered from s group by all), t as (select doc_id, item_id, max(n) + 11 as longest from (select doc_id, item_id, streak, count(*) as n from s group by all) group by all)
select item_id, count(*) as documents, cast(max(longest) as int) as longest_run, cast(count(*) filter (covered = words) as bigint) as in_full from r join t using (doc_id, item_id) group by item_id"""
