"""Every registered query of the engine against its SQL."""

import pytest

from tessavec.queries import QUERIES, SQL
from tests.oracle import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = rows_of_spark(QUERIES[name](spark, SF))
    if name in SQL:
        assert found == rows_of_sql(SQL[name], SF)
    else:
        assert found[1]


def test_ann_recall(spark):
    rows = QUERIES["ann_recall"](spark, SF).collect()
    assert sum(r.hits for r in rows) >= 0.9 * sum(r.asked for r in rows) and all(r.asked == 5 for r in rows)
    assert sum(r.scored for r in rows) < 500 * len(rows)
