"""The operators on records and vectors against straight definitions, with dirty and skewed rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspace.llm import clusters, collision, cooccurrence, deliveries, distinctive, neardup, pairs, spans, termfreq

BODIES = "pos string, field string, number long, body string, h int, n int, left string"
WORDS = "field string, number long, words array<string>, term string, n int"


def bodies(spark, rows, field="f"):
    return spark.createDataFrame([("x", field, k, b, 1, 2, "y") for k, b in rows], BODIES)


# --- spans ------------------------------------------------------------------------------------------------------


def brute_spans(rows, run, split):
    seqs = {k: split(b) for k, b in rows if k is not None and b is not None}
    where = defaultdict(set)
    for k, s in seqs.items():
        for i in range(len(s) - run + 1):
            where[tuple(s[i : i + run])].add((k, i))
    pairs, covered = set(), defaultdict(set)
    for places in where.values():
        keys = {k for k, _ in places}
        if len(keys) > 1:
            pairs |= {(a, b) for a in keys for b in keys if a < b}
            for k, i in places:
                covered[k] |= set(range(i, i + run))
    return pairs, covered


def covered_by(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.number] |= set(range(r.start, r.stop))
    return out


@pytest.mark.parametrize("options", [{}, {"group_suffixes": 3, "small": 0}, {"hot": 1, "chunk": 2}, {"hot": 3, "small": 2}])
def test_shared_spans_of_characters(spark, options):
    rng = random.Random(3)
    shared = ["".join(rng.choice("abc ") for _ in range(n)) for n in (59, 60, 61, 130, 400)]
    rows = [(None, shared[3]), (1, None), (2, ""), (3, "short")]
    for k in range(10, 40):
        own = "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 300)))
        rows.append((k, own[:100] + (rng.choice(shared) if k % 3 else "") + own[100:]))
    rows += [(50, shared[4]), (51, shared[4]), (52, shared[4]), (50, shared[4])]  # copies and a repeated delivery
    rows += [(60, "z" * 200), (61, "z" * 200 + "y"), (62, "𐤀" * 70), (63, "𐤀" * 75)]
    rows += [(64, (a := "".join(rng.choice("gh") for _ in range(80))) + "q" + a)]  # repeated only within itself
    pairs, covered = brute_spans(rows, 60, str)
    runs = {"f": ("char", 60)}
    got = spans.shared_spans(bodies(spark, rows), runs, **options).collect()
    assert len(got) == len({(r.number_a, r.number_b) for r in got})
    assert {(r.number_a, r.number_b) for r in got} == pairs
    assert covered_by(spans.shared_spans(bodies(spark, rows), runs, pairs=False, **options).collect()) == covered


@pytest.mark.parametrize("options", [{}, {"small": 0}, {"hot": 1, "chunk": 1}])
def test_shared_spans_of_tokens(spark, options):
    rng = random.Random(4)
    vocab = ["a", "b", "ab", "", "\x1f", "\x1e", "\x1e1", "ב"]
    base = [rng.choice(vocab) for _ in range(40)]
    lists = {k: [rng.choice(vocab) for _ in range(30)] + (base[: 8 + k] if k % 2 else []) for k in range(12)}
    df = spark.createDataFrame([(k, [*v, None]) for k, v in lists.items()] + [(99, None), (98, [])], "number long, w array<string>")
    rows = df.select(F.lit("t").alias("field"), "number", spans.token_body(F.col("w")).alias("body"))
    got = {(r.number_a, r.number_b) for r in spans.shared_spans(rows, {"t": ("token", 12)}, **options).collect()}
    pairs, covered = brute_spans(list(lists.items()), 12, list)
    assert got == pairs and got
    assert covered_by(spans.shared_spans(rows, {"t": ("token", 12)}, pairs=False, **options).collect()) == covered


def test_spans_of_an_empty_table(spark):
    assert spans.shared_spans(bodies(spark, [(1, "a")]).limit(0), {"f": ("char", 60)}).count() == 0


@pytest.mark.parametrize("options", [{}, {"small": 8}, {"hot": 20, "chunk": 15}])
def test_a_refrain_in_a_third_of_all_records(spark, options):
    rng = random.Random(5)
    refrain = "".join(rng.choice("abcdefgh") for _ in range(90))
    rows = [(k, "".join(rng.choice("ijklmnop") for _ in range(70)) + (refrain if k % 3 == 0 else "") + "".join(rng.choice("qrstuvw") for _ in range(20))) for k in range(300)]
    got = {(r.number_a, r.number_b) for r in spans.shared_spans(bodies(spark, rows), {"f": ("char", 60)}, **options).collect()}
    assert got == {(a, b) for a in range(0, 300, 3) for b in range(0, 300, 3) if a < b}


# --- term frequencies, association ------------------------------------------------------------------------------


def words(spark, rows):
    return spark.createDataFrame([("f", k, w, "clash", 7) for k, w in rows], WORDS)


DIRTY = [(1, ["a", "a", None, "", "b"]), (1, ["a", "a", None, "", "b"]), (2, ["a", "c"]), (3, None), (4, []), (None, ["a"]), (5, ["a"]), (6, ["b", "ב", "a"]), (7, ["a"]), (8, ["x" * 5000, "a"])]


@pytest.mark.parametrize("rows_in_memory", [2_000_000, 1])
def test_term_counts(spark, rows_in_memory):
    got = {(r.term): (r.occurrences, r.records, r.mark) for r in termfreq.marked_terms(words(spark, DIRTY), rows_in_memory=rows_in_memory).collect()}
    assert got == {"a": (7, 6, "common"), "b": (2, 2, "rare"), "c": (1, 1, "rare"), "ב": (1, 1, "rare"), "x" * 5000: (1, 1, "rare")}


def test_radix_files_are_split_until_they_fit(spark):
    rows = [(k, [f"w{(k * 7 + j) % 997}" for j in range(40)] + ["hot"] * 60) for k in range(200)]
    got = {r.term: (r.occurrences, r.records) for r in termfreq.marked_terms(words(spark, rows), rows_in_memory=20).collect()}
    n, d = Counter(), Counter()
    for _, w in rows:
        n.update(w)
        d.update(set(w))
    assert got == {t: (n[t], d[t]) for t in n}


def test_term_counts_of_an_empty_table(spark):
    assert termfreq.marked_terms(words(spark, DIRTY).limit(0)).count() == 0


def test_association(spark):
    rows = {r.number: 0 for r in distinctive.association(words(spark, DIRTY)).collect()}
    assert set(rows) == {1, 2, 5, 6, 7, 8}
    bags = {1: ["a", "a", "", "b"], 2: ["a", "c"], 5: ["a"], 6: ["b", "ב", "a"], 7: ["a"], 8: ["x" * 5000, "a"]}
    occ = Counter(t for b in bags.values() for t in b)
    df = Counter(t for b in bags.values() for t in set(b))
    context = sum(len(b) ** 0.75 for b in bags.values())
    for r in distinctive.association(words(spark, DIRTY)).collect():
        tf = bags[r.number].count(r.term)
        assert (r.tf, r.df) == (tf, df[r.term])
        assert r.ppmi == pytest.approx(max(0, math.log(tf * context / (occ[r.term] * len(bags[r.number]) ** 0.75))))
        assert r.tf_icf == pytest.approx(math.log1p(tf) * (math.log(9 / (df[r.term] + 1)) + 1))


def test_most_distinctive_keeps_ties(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["d"]), (4, ["d", "d", "a"])]
    got = {(r.number, r.term) for r in distinctive.most_distinctive(words(spark, rows)).collect()}
    assert got == {(1, "b"), (2, "b"), (3, "d"), (4, "d")} | ({(1, "a"), (2, "a")} if False else set())
    tied = {(r.number, r.term) for r in distinctive.most_distinctive(words(spark, [(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"])])).collect()}
    assert tied == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    assert distinctive.most_distinctive(words(spark, rows).limit(0)).count() == 0


# --- co-occurrence ----------------------------------------------------------------------------------------------


def brute_pairs(baskets):
    sets = [s for b in baskets if b is not None and (s := {x for x in b if x is not None})]
    one, two = Counter(x for s in sets for x in s), Counter((a, b) for s in sets for a in s for b in s if a < b)
    return {(a, b): (n, one[a], one[b], len(sets)) for (a, b), n in two.items()}


def test_together(spark):
    rng = random.Random(6)
    baskets = [None, [], [None], ["", "a"], ["b", "b", None, "a"]] + [[f"i{int(rng.expovariate(0.1))}" for _ in range(rng.randint(0, 9))] + (["hot"] if k % 3 == 0 else []) for k in range(300)]
    df = spark.createDataFrame([(b, "x", 1) for b in baskets], "items array<string>, item_a string, n int")
    for block in (20_000, 7):
        got = {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.baskets) for r in cooccurrence.together(df, block_baskets=block).collect()}
        assert got == brute_pairs(baskets)
    some = cooccurrence.together(df, least=5).collect()
    assert {(r.item_a, r.item_b) for r in some} == {p for p, (n, *_) in brute_pairs(baskets).items() if n >= 5}
    assert all(r.lift == pytest.approx(r.n * r.baskets / (r.n_a * r.n_b)) for r in some)
    assert cooccurrence.together(df.limit(0)).count() == 0


def test_cells_leave_the_task_in_bounded_rounds(monkeypatch):
    rng = random.Random(7)
    baskets = [[f"i{rng.randint(0, 40)}" for _ in range(6)] for _ in range(200)]
    batches = [pa.record_batch({"items": pa.array([sorted(set(b)) for b in baskets[lo : lo + 30]])}) for lo in range(0, 200, 30)]
    for held in (2_000_000, 50):
        monkeypatch.setattr(cooccurrence, "HELD_CELLS", held)
        got, rounds = Counter(), 0
        for b in cooccurrence.products(iter(batches), 20):
            rounds += 1
            for r in b.to_pylist():
                got[r["item_a"], r["item_b"]] += r["n"]
        pairs = brute_pairs(baskets)
        assert got.pop((None, None)) == 200 and {p: n for p, n in got.items() if p[0] != p[1]} == {p: n for p, (n, *_) in pairs.items()}
        assert all(got[a, a] == n_a and got[b, b] == n_b for (a, b), (_, n_a, n_b, _) in pairs.items()) and (rounds > 2) == (held == 50)


def test_gram_by_blocks_of_items():
    rng = np.random.default_rng(1)
    x = rng.random((50, 30)) < 0.2
    owner, code = np.nonzero(x)
    want = x.T.astype(int) @ x.astype(int)
    for width in (4096, 7):
        got = np.zeros_like(want)
        for a, b, n in cooccurrence.gram(code, owner, width):
            got[a, b] += n
        assert (got == np.triu(want, 1)).all()


# --- near-duplicates --------------------------------------------------------------------------------------------


def brute_similar(rows):
    bags = {k: Counter(b.split()) for k, b in rows if k is not None and b and b.split()}
    out = set()
    for a in bags:
        for b in bags:
            if a < b:
                i = sum((bags[a] & bags[b]).values())
                if 10 * i >= 7 * (bags[a].total() + bags[b].total() - i):
                    out.add((a, b))
    return out


def edited(rng, ws):
    ws = ws[:]
    for _ in range(rng.randint(0, max(1, len(ws) // 4))):
        if rng.random() < 0.4 and ws:
            ws.pop(rng.randrange(len(ws)))
        else:
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(["new", "w1", f"q{rng.randint(0, 99)}"]))
    rng.shuffle(ws)
    return ws


@pytest.mark.parametrize("options", [{}, {"hot": 3, "chunk": 2}])
def test_near_duplicates(spark, options):
    rng = random.Random(7)
    texts = [[f"w{int(rng.expovariate(0.05))}" for _ in range(n)] for n in (1, 2, 3, 4, 5, 8, 13, 30, 60, 90, 150, 400)]
    rows = [(None, "a b"), (1, None), (2, ""), (3, "   "), (4, "one two"), (5, "two  one\n"), (5, "two  one\n")]
    for k in range(10, 110):
        rows.append((k, " ".join(edited(rng, texts[k % len(texts)]))))
    rows += [(k, "copy of the same words") for k in range(200, 230)]
    found = neardup.expanded(*neardup.similar_pairs(bodies(spark, rows), {"f": "space"}, **options)).collect()
    got = [(r.number_a, r.number_b) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute_similar(rows) and len(got) > 500


def test_near_duplicate_groups(spark):
    a = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:17])), (3, " ".join(a[:14])), (4, "else"), (5, "else")]
    got = {r.number: (r.class_id, r.links, r.group_id) for r in neardup.groups(*neardup.similar_pairs(bodies(spark, rows), {"f": "space"})).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 2, 1), 3: (3, 2, 1), 4: (4, 0, 4), 5: (4, 0, 4)}
    pairs, members = neardup.similar_pairs(bodies(spark, rows).limit(0), {"f": "space"})
    assert pairs.count() == 0 and members.count() == 0


# --- vectors ----------------------------------------------------------------------------------------------------

VECTORS = "node_id long, vector array<float>, key string, hash int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "k", 1) for k, v in rows], VECTORS)


def planted(rng, n_clusters, size, dim=64, noise=0.08):
    out = []
    for c in range(n_clusters):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size if c else size * 4):
            out.append((c, (centre + noise * rng.standard_normal(dim)) * rng.uniform(0.5, 3)))
    return out


UNUSABLE = [(9001, None), (9002, []), (9003, [1.0] * 63), (9004, [math.nan] + [1.0] * 63), (9005, [math.inf] + [1.0] * 63), (9006, [0.0] * 64), (9007, [None] + [1.0] * 63), (None, [1.0] * 64)]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    made = planted(rng, 12, 25)
    made += [(99, rng.standard_normal(64)) for _ in range(60)]
    rows = [(i, v) for i, (_, v) in enumerate(made)]
    twice = [(i, v * 2) for i, v in rows[:40]]
    df = vectors(spark, rows + twice + UNUSABLE)
    asked = spark.createDataFrame([(k,) for k in [*range(0, len(rows), 3), 0, 9003, 424242, None]], "q long")
    x = np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    for options in ({}, {"queries_per_pass": 20}):
        got = defaultdict(list)
        for r in collision.nearest(df, asked, **options).orderBy("query", "rank").collect():
            got[r["query"]].append(r.neighbour)
        assert set(got) == set(range(0, len(rows), 3))
        right = sum(len(set(v) & set(np.argsort(-cos[q])[:5].tolist())) for q, v in got.items())
        assert right >= 0.99 * 5 * len(got) and all(len(v) == 5 for v in got.values())


def test_fewer_neighbours_than_asked(spark):
    df = vectors(spark, [(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64), *UNUSABLE])
    got = {(r["query"], r.neighbour, r["rank"]) for r in collision.nearest(df, df.select("node_id")).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
    assert collision.nearest(df.limit(0), df.select("node_id").limit(0)).count() == 0


def test_blocks_of_the_index(spark, monkeypatch):
    """Every row is in one block, whatever the batches; without levels a query is compared with all."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(64)) for i in range(70)]
    monkeypatch.setattr(collision, "BLOCK_ROWS", 16)
    batches = [pa.record_batch({"key": pa.array(range(a, b)), "vector": pa.array([list(v) for _, v in rows[a:b]], pa.list_(pa.float32()))}) for a, b in ((0, 5), (5, 50), (50, 50), (50, 70))]
    blocks = list(collision._blocks(iter(batches), 64))
    assert [len(k) for k, _ in blocks] == [16, 16, 16, 16, 6] and np.concatenate([k for k, _ in blocks]).tolist() == list(range(70))
    x = np.array([v for _, v in rows])
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    np.fill_diagonal(cos, -2)
    found = collision.nearest(vectors(spark, rows), spark.range(70), levels=((1e-3, 1, 2),)).collect()
    assert {(r["query"], r["rank"]): r.neighbour for r in found} == {(q, k + 1): int(n) for q in range(70) for k, n in enumerate(np.argsort(-cos[q])[:5])}


def test_equal_vectors_go_to_the_smaller_keys(spark):
    df = vectors(spark, [(i, [1.0] + [0.5] * 63) for i in range(12, 0, -1)])
    got = {(r["query"], r.neighbour) for r in collision.nearest(df, df.select("node_id"), k=2).collect()}
    assert got == {(q, n) for q in range(1, 13) for n in [x for x in (1, 2, 3) if x != q][:2]}


@pytest.mark.parametrize("block", [8192, 16])
def test_clusters(spark, block):
    rng = np.random.default_rng(3)
    made = planted(rng, 8, 20)
    rows = [(i, v) for i, (_, v) in enumerate(made)]
    lone = [(1000 + i, rng.standard_normal(64)) for i in range(40)]
    df = vectors(spark, rows + lone + [(i, v * 3) for i, v in rows[:30]] + UNUSABLE)
    got = clusters.clusters(df, block=block, later=block).collect()
    assert len(got) == len(rows) + len(lone)
    own = {r.key: r for r in got}
    names = {}
    for i, (c, _) in enumerate(made):
        names.setdefault(c, own[i].cluster)
        assert own[i].cluster == names[c] is not None
    assert len(set(names.values())) == 8
    assert {own[i]["size"] for i, (c, _) in enumerate(made) if c == 0} == {80}
    assert all(own[k].cluster is None for k, _ in lone)
    medoids = [r for r in got if r.medoid_rank is not None]
    assert len(medoids) == 24 and all(r.cosine >= max(o.cosine for o in got if o.cluster == r.cluster and o.medoid_rank is None) for r in medoids)


def test_clusters_of_an_empty_table(spark):
    assert clusters.clusters(vectors(spark, UNUSABLE)).count() == 0


def test_first_deliveries(spark):
    rows = [(1, ["b"]), (1, ["a"]), (1, ["b"]), (2, None), (3, ["c"]), (3, ["c"]), (None, ["d"]), (4, []), (5, None), (5, ["e"])]
    df = spark.createDataFrame([(k, w, "x") for k, w in rows], "number long, words array<string>, _n string")
    got = deliveries.first_deliveries(df, ["number"], "words").collect()
    assert {(r.number, None if r.words is None else tuple(r.words)) for r in got} == {(1, ("a",)), (2, None), (3, ("c",)), (4, ()), (5, ("e",))} and len(got) == 5
    assert deliveries.first_deliveries(df.limit(0), ["number"], "words").count() == 0


@pytest.mark.parametrize("part", [4096, 1, 3])
def test_pairs_within_groups(spark, part):
    rows = [("a", x) for x in (5, 1, 3, 3, 9, 8, 2)] + [("b", 1), ("b", 2), ("c", 7), (None, 1), (None, 2), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = [tuple(r) for r in pairs.pairs_within(df, ["g"], "x", "lo", "hi", part).collect()]
    want = {("a", p, q) for p in (1, 2, 3, 5, 8, 9) for q in (1, 2, 3, 5, 8, 9) if p < q} | {("b", 1, 2)}
    assert len(got) == len(want) and set(got) == want
