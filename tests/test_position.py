import pytest
from fixtures import groups, long, weights

from lexspace.operators import position, recurrence
from lexspace.operators.shuffle import numpy_order, shuffled_order
from lexspace.plans.constructions import build, prepare
from lexspace.sources.corpus import segments

import numpy as np
from pyspark.sql import functions as F

FIVE = [["sun"], ["moon", "sun"], [], [], ["star"]]
WEIGHTS = {"moon": 1.5, "star": 7.0, "sun": 4.0}  # places 0, 1, 2


def p(spark, *groups_, **w):
    return prepare(groups(spark, *groups_), "lexeme", weights=weights(spark, **w) if w else None)


def order(spark, *perm, group=1):
    return spark.createDataFrame([(group, i, s) for i, s in enumerate(perm)], "group_id int, position int, seg_idx int")


def test_places_and_bins(spark):
    at = F.col("id")
    rows = spark.range(5).select(at, position.place(at, F.lit(5)).alias("t"), position.place_bin(at, F.lit(5), 2).alias("b2"), position.place_bin(at, F.lit(5), 4).alias("b4")).orderBy("id").collect()
    assert [round(r.t, 9) for r in rows] == [0.1, 0.3, 0.5, 0.7, 0.9]
    assert [r.b2 for r in rows] == [0, 0, 1, 1, 1] and [r.b4 for r in rows] == [0, 1, 2, 2, 3]
    assert spark.range(1).select(position.place(F.col("id"), F.lit(1)).alias("t")).first().t == 0.5


@pytest.mark.parametrize("k", [2, 4, 8])
def test_bins_equal_whole_number_arithmetic(spark, k):
    rows = spark.range(1, 120).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("p"))
    got = rows.select("n", "p", position.place_bin(F.col("p"), F.col("n"), k).alias("b"), F.when(F.col("n") > 1, recurrence.lag_bin(F.col("p"), F.greatest(F.col("n"), F.lit(2)), k)).alias("l")).collect()
    for r in got:
        assert r.b == min((2 * r.p + 1) * k // (2 * r.n), k - 1)
        assert r.n == 1 or r.l == min(r.p * k // (r.n - 1), k - 1)


def test_pyramid(spark):
    assert long(build("icf_position2", p(spark, FIVE, **WEIGHTS))) == {100: {2: 4}, 101: {0: 1.5, 2: 4}, 104: {4: 7}}


def test_pyramid_in_another_order(spark):
    made = build("icf_position2", p(spark, FIVE, **WEIGHTS), order(spark, 4, 3, 2, 1, 0))
    assert long(made) == {104: {1: 7}, 101: {3: 1.5, 5: 4}, 100: {5: 4}}


def test_group_pyramid(spark):
    every = range(100, 105)
    assert long(build("icf_position2_psalm", p(spark, FIVE, **WEIGHTS))) == dict.fromkeys(every, {0: 1.5, 2: 8, 4: 7})
    assert long(build("icf_position2_psalm", p(spark, FIVE, **WEIGHTS), order(spark, 4, 3, 2, 1, 0))) == dict.fromkeys(every, {1: 7, 3: 1.5, 5: 8})


def test_pyramid_of_one_bin_is_icf(spark):
    made = p(spark, [["A", "B", "A"], ["B"], ["C"]], A=2, B=3, C=5)
    plain = long(build("icf", made))
    assert long(position.pyramid(made.tf, 1)) == plain
    assert long(position.pyramid(made.tf, 1, order(spark, 2, 0, 1))) == plain
    total = {r.idx: r.val for r in position.group_pyramid(made.tf, 1).collect()}
    assert total == {0: 2, 1: 6, 2: 5}


def test_zoning(spark):
    made = p(spark, [["A"], [], [], []], A=4)
    assert long(build("icf_position_mean", made)) == {100: {0: 4, 1: -3}}
    assert long(build("icf_position_mean_psalm", made)) == dict.fromkeys((100, 101, 102, 103), {0: 4, 1: -3})


def test_zoning_of_a_value_everywhere_is_nought(spark):
    got = long(build("icf_position_mean_psalm", p(spark, [["A", "A"], ["A"], ["A"], ["A"]], A=4)))
    assert all(abs(v[1]) < 1e-12 for v in got.values())


def test_zoning_counts_segments_not_occurrences(spark):
    got = long(build("icf_position_mean_psalm", p(spark, [["A", "A", "A"], ["A"], []], A=1)))
    assert got[102][1] == pytest.approx(2 * (1 / 6 + 3 / 6) / 2 - 1)


def test_presence_half_ignores_order_mean_half_does_not(spark):
    made = p(spark, [["A"], ["B"], ["C"]], A=1, B=1, C=1)
    one, two = long(build("icf_position_mean", made)), long(build("icf_position_mean", made, order(spark, 2, 0, 1)))
    assert all(one[n][i] == two[n][i] for n in one for i in one[n] if i < 3)
    assert one != two


def test_lags(spark):
    rows = recurrence.pair_lags(segments(groups(spark, [["A"]] * 4, [["A"]]))).orderBy("i", "j").collect()
    assert [round(r.lag, 9) for r in rows] == [round(x, 9) for x in (1 / 3, 2 / 3, 1, 1 / 3, 2 / 3, 1 / 3)]


def brute_profile(segs, w, k):
    """Straight from the definition: mean cosine to all others of each lag bin."""
    vocab = sorted({v for s in segs for v in s})
    x = np.array([[w[v] if v in s else 0.0 for v in vocab] for s in segs])
    n = len(segs)
    norm = np.linalg.norm(x, axis=1)
    cos = x @ x.T / np.outer(np.where(norm == 0, 1, norm), np.where(norm == 0, 1, norm))
    seg, grp = {}, {}
    for i in range(n):
        for j in range(n):
            if i != j:
                b = min(abs(i - j) * k // (n - 1), k - 1)
                seg.setdefault((i, b), []).append(cos[i, j])
                if i < j:
                    grp.setdefault(b, []).append(cos[i, j])
    return {k_: np.mean(v) for k_, v in seg.items()}, {b: np.mean(v) for b, v in grp.items()}


@pytest.mark.parametrize("k", [2, 4, 8])
def test_recurrence_against_the_definition(spark, k):
    rng = np.random.default_rng(k)
    shapes = [[["A", "B"], ["A", "B"], ["C"], [], ["E", "A"], ["F"]], [["A"], ["A"]], [["B"]]]
    shapes += [[[str(x) for x in rng.choice(list("ABCDEFG"), rng.integers(0, 4))] for _ in range(rng.integers(3, 14))] for _ in range(3)]
    w = {c: 1.0 + i for i, c in enumerate("ABCDEFG")}
    made = p(spark, *shapes, **w)
    seg, grp = long(build(f"icf_spacing{k}", made)), {}
    for r in recurrence.group_spacing(made.tf, made.segments, k).collect():
        grp.setdefault(r.group_id, {})[r.idx] = r.val
    for g, segs in enumerate(shapes):
        own, whole = brute_profile(segs, w, k)
        for i in range(len(segs)):
            assert seg.get(100 + 1000 * g + i, {}) == pytest.approx({b: v for (x, b), v in own.items() if x == i}, abs=1e-8)
        assert grp.get(g + 1, {}) == pytest.approx(whole, abs=1e-9)


def test_near_bin_above_far_bin(spark):
    got = long(build("icf_spacing2", p(spark, [["A", "B"], ["A", "B"], ["C"], ["D"], ["E"], ["F"]])))
    assert got[100][0] > got[100][1]


def test_orders_are_permutations(spark):
    own = segments(groups(spark, [["A"]] * 9, [["A"]] * 5, [["A"]]))
    rows = shuffled_order(own, [1, 2]).collect()
    for g, n in ((1, 9), (2, 5), (3, 1)):
        for s in (1, 2):
            mine = sorted((r.position, r.seg_idx) for r in rows if (r.group_id, r.seed) == (g, s))
            assert [x for x, _ in mine] == list(range(n)) and sorted(y for _, y in mine) == list(range(n))
    assert rows == shuffled_order(own, [1, 2]).collect()


def test_numpy_order_is_numpys(spark):
    own = segments(groups(spark, [["A"]] * 9, [["A"]]))
    got = {}
    for r in numpy_order(own, 7).collect():
        got.setdefault(r.group_id, {})[r.position] = r.seg_idx
    assert [got[1][i] for i in range(9)] == np.random.default_rng((1, 7)).permutation(9).tolist() and got[2] == {0: 0}
