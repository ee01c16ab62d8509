"""Rasters that do not vary: what is divided by their spread is NaN, as in SQL, and no error."""

import math

from geoloom.operators import colour, stats
from tests.geo.test_operators import grid, values


def test_balance_contrast_enhancement(spark):
    flat = grid(spark, [[1, 1, None], [1, 1, 1]])
    got = values(colour.balance_contrast_enhancement(flat))
    assert got.pop((0, 2)) is None
    assert len(got) == 5 and all(math.isnan(z) for z in got.values())
    ends = values(colour.balance_contrast_enhancement(grid(spark, [[1, 2, 4]])))
    assert abs(ends[0, 0]) < 1e-9 and abs(ends[0, 2] - 255) < 1e-9
    composite = grid(spark, [[(255 << 24) + 7, (255 << 24) + (9 << 8) + 7]])  # red and blue do not vary
    assert {z - (255 << 24) for z in values(colour.balance_contrast_enhancement_composite(composite)).values()} <= {0.0, 255.0 * 256}


def test_write_function_memory_insertion(spark):
    """A date that does not vary has the tone 0, its NoData stays."""
    one, flat = grid(spark, [[1, 2, 3, 4]]), grid(spark, [[7, 7, None, 7]])
    opaque = 255 << 24
    assert values(colour.write_function_memory_insertion([one, flat])) == {(0, 0): opaque, (0, 1): opaque + 85, (0, 2): None, (0, 3): opaque + 255}
    assert values(colour.write_function_memory_insertion([flat, one])) == {(0, 0): opaque, (0, 1): opaque + 85 * 65792, (0, 2): None, (0, 3): opaque + 255 * 65792}


def test_anova(spark):
    classes = grid(spark, [[1, 1, 2, 2]])
    f = lambda rows, c=classes: stats.anova(grid(spark, rows), c).first()
    flat = f([[3, 3, 3, 3]])
    assert (flat.ssb, flat.ssw, flat.df1, flat.df2) == (0, 0, 1, 2) and math.isnan(flat.f)
    assert f([[3, 3, 4, 4]]).f == math.inf  # all variation is between the classes
    assert math.isnan(f([[1, 2, 3, 4]], grid(spark, [[5, 5, 5, 5]])).f)  # one class
    assert math.isnan(f([[1, 2, None, None]], grid(spark, [[5, 6, 7, 8]])).f)  # one cell in each class
    assert f([[1, 2, 3, 4]]).f == 8
    assert f([[None] * 4]).f is None


def test_morans_i(spark):
    flat = stats.morans_i(grid(spark, [[2, 2, None], [2, 2, 2]]), "king").first()
    assert (flat.n, flat.mean, flat.expected) == (5, 2, -0.25) and math.isnan(flat.i)
    apart = stats.morans_i(grid(spark, [[1, None, 3]])).first()  # no neighbours
    assert (apart.n, apart.expected) == (2, -1) and math.isnan(apart.i)
    alone = stats.morans_i(grid(spark, [[1]])).first()
    assert (alone.n, alone.expected) == (1, -math.inf) and math.isnan(alone.i)
    assert stats.morans_i(grid(spark, [[1, 2]])).first().i == -1


def test_image_correlation(spark):
    rasters = [grid(spark, rows) for rows in ([[1, 2, 3, 4]], [[5, 5, 5, 5]], [[2, 4, None, 8]], [[None, None, 1, None]])]
    r = {(x.i, x.j): x.r for x in stats.image_correlation(rasters).collect()}
    assert len(r) == 6 and abs(r[2, 0] - 1) < 1e-12 and r[3, 2] is None  # no cell is valid in both
    assert all(math.isnan(r[k]) for k in ((1, 0), (2, 1), (3, 0), (3, 1)))
