"""Reclassing by large tables of ranges."""

from geoloom.operators import local


def test_more_than_ten_thousand_ranges(spark):
    n = 12_000
    ranges = spark.createDataFrame([(float(-i), float(i), float(i + 1)) for i in range(n)] + [(5.0, 0.0, 1e9)], "new double, low double, high double").coalesce(1)
    cells = [(0, i, i + 0.5) for i in range(n)] + [(1, 0, None), (1, 1, -0.5), (1, 2, float(n)), (1, 3, 1e9), (1, 4, 3.0)]
    got = {(r.row, r.col): r.z for r in local.reclass_from_table(spark.createDataFrame(cells, "row int, col int, z double"), ranges).collect()}
    assert all(got[0, i] == -i for i in range(n))
    assert [got[1, i] for i in range(5)] == [None, -0.5, 5.0, 1e9, -3.0]
