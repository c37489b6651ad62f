"""The queries of whole groups have a row for each segment, for every unit."""

import os

import pytest

import __spark_entry__ as entry
from lexspace import queries as core
from test_entry import SF, db, rows  # noqa: F401 (a fixture)

SOME = [("homograph", "icf_position4_psalm"), ("consonantal", "icf_spacing4_psalm"), ("vocalized", "icf_position_mean_psalm"), ("cantillation", "icf_position2_psalm")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize(("unit", "name"), SOME)
def test_group_vectors_stand_on_each_segment(spark, db, unit, name):  # noqa: F811
    df = entry.queries()[f"{core.unit_name(unit)}_{name}"](spark, SF)
    assert df.columns == ["node_id", "idx", "val"]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(df.columns, db.execute(core.construction_sql(name, unit)).fetchall())


def test_shuffled_group_vectors_stand_on_each_segment(spark, db):  # noqa: F811
    df = entry.queries()["icf_position_mean_psalm_shuffle"](spark, SF)
    assert df.columns == ["seed", "node_id", "idx", "val"]
    want = db.execute(core.ORACLE_SQL["icf_position_mean_psalm_shuffle"])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())
