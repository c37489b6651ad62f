"""How much of each psalm stands elsewhere too."""

import random

from lexspace.llm import queries


def test_every_psalm_has_its_share(spark, tmp_path):
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("אבגדה") for _ in range(n))
    passage = own(70)
    texts = {1: [passage, own(29)], 2: [own(129), passage], 3: [own(50)], 4: None, 5: [None, ""], 6: [passage]}
    lexemes = {1: [list("abcdefghijkl"), ["x", None, "y"]], 2: [["z"], list("abcdefghijkl")], 3: [["a\x1f"]], 4: None, 5: [[], None], 6: [list("abc")]}
    rows = [*texts.items(), (1, texts[1]), (None, [passage])]
    spark.createDataFrame(rows, "number int, half_verses_unvocalized array<string>").write.parquet(f"{tmp_path}/psalm.parquet")
    spark.createDataFrame([*lexemes.items()], "number int, half_verse_lexemes array<array<string>>").write.parquet(f"{tmp_path}/lexical_psalm.parquet")
    got = queries.p1_shared(spark, str(tmp_path)).collect()
    assert len(got) == 12
    by = {(r.field_name, r.number): (r.shared, r.total, round(r.share, 6)) for r in got}
    text = {1: (70, 100, 0.7), 2: (70, 200, 0.35), 3: (0, 50, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (70, 70, 1)}
    words = {1: (12, 14, 0.857143), 2: (12, 13, 0.923077), 3: (0, 1, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 3, 0)}
    assert {k: by["unvocalized", k] for k in text} == text
    assert {k: by["lexemes", k] for k in words} == words


def test_operators_leave_nothing_that_is_not_needed(spark, tmp_path, monkeypatch):
    """Within `intermediates` everything is deleted at the end; the tables that no result reads go before."""
    import os

    from lexspace import storage
    from lexspace.llm import clusters, collision, neardup

    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    labels = lambda: sorted(f.rpartition("-")[0] for f in os.listdir(tmp_path / "lexspace"))
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(30)], "node_id long, vector array<float>")
    bodies = spark.createDataFrame([("f", k, " ".join(rng.choices("abcdefgh", k=30))) for k in range(20)], "field string, number long, body string")
    with storage.intermediates(spark):
        assert collision.nearest(vectors, vectors.select("node_id")).count() == 150 and labels() == ["p5-best"]
        assert clusters.clusters(vectors).count() == 30 and labels() == ["p4-assigned", "p5-best"]
        neardup.expanded(*neardup.similar_pairs(bodies, {"f": "space"})).count()
        assert labels() == ["p4-assigned", "p5-best", "p6-members", "p6-pairs"]
    assert labels() == []
