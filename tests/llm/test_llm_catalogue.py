"""The queries of the problems exist, run on the smallest tables and have the columns the problems name."""

import os

import pytest

from textquarry.llm.catalogue import QUERIES, SQL

DATA = os.environ.get("TQ_TEST_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["row_id_a", "row_id_b"], "p2_found": ["target_id"], "p3_found": ["rec_id", "group_key"], "p4_found": ["cache_id_a", "cache_id_b"],
    "p5_ids": ["doc_id", "ids"], "p6_found": ["mix_id", "source"], "p7_found": ["doc_id", "start_pos", "end_pos"],
}


def test_every_problem_has_its_query():
    assert set(COLUMNS) <= set(QUERIES) and set(SQL) <= set(QUERIES)
    assert {name.split("_")[0] for name in QUERIES} == {f"p{n}" for n in range(1, 8)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
    if name in ("p1_found", "p4_found"):
        assert all(r[0] < r[1] for r in rows)
