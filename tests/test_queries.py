import os

import oracles
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    sql = entry.oracle_sql()
    if name in sql:
        assert oracles.differ(spark, oracles.views(SF), name, entry.queries()[name], sql[name], SF) == ""
    else:
        assert entry.queries()[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sort_places_the_whole_table(spark):
    part = sorted((r.p_size, r.p_partkey) for r in spark.read.parquet(f"{SF}/part.parquet").collect())
    got = entry.queries()["three_state_sort_whole"](spark, SF).collect()
    for state, want in (("off", sorted(part, key=lambda r: r[1])), ("asc", part), ("desc", part[::-1])):
        assert [(r.p_size, r.p_partkey) for r in sorted((r for r in got if r.state == state), key=lambda r: r.place)] == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["shoot_id", "burst_id", "frame_id", "penalty", "sharpness"]
