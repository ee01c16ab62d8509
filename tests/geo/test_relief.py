"""Terrain at many scales and along rays: small cases with known answers, and no dependence on tiles."""

import math

import numpy as np
import pytest

from geoloom.functions import relief
from geoloom.operators import multiscale as op
from tests.geo.test_operators import grid, noise, values


@pytest.mark.parametrize(
    "run",
    [
        lambda d, t: op.strongest(d, [1, 2, 4], "roughness", t),
        lambda d, t: op.strongest(d, [1, 3], "std_dev_normals", t),
        lambda d, t: op.strongest(d, [1, 3], "percentile", t),
        lambda d, t: op.strongest(d, [2, 5], "anisotropy", t),
        lambda d, t: op.feature_preserving_smoothing(d, 5, 80.0, 2, 9.0, t),
        lambda d, t: op.drainage_preserving_smoothing(d, 5, 80.0, 2, 9.0, tile=t),
        lambda d, t: op.fill_missing_data(d, 5, tile=t),
        lambda d, t: op.remove_off_terrain_objects(d, 5, 45.0, t),
        lambda d, t: op.directional_relief(d, 30.0, 6, t),
        lambda d, t: op.fetch_analysis(d, 200.0, 0.1, 7, t),
        lambda d, t: op.geomorphons(d, 6, 1.0, tile=t),
        lambda d, t: op.visibility_index(d, 2.0, 2, 5, t),
        lambda d, t: op.exposure_towards_wind_flux(d, 100.0, 5, t),
        lambda d, t: op.time_in_daylight(d, 45.0, 45.0, 6, (80,), (9.0, 15.0), t),
        lambda d, t: op.viewshed(d, d.select("row", "col").filter("row = col AND row % 5 = 0"), 2.0, 8, t),
        lambda d, t: op.gaussian_scale_space(d, steps=2, tile=t),
    ],
)
def test_tiles_do_not_matter(spark, run):
    rows = noise(21, 11)
    rows[4][7] = rows[12][3] = None
    dem = grid(spark, rows)
    small, whole = values(run(dem, 6)), values(run(dem, 64))
    assert small.keys() == whole.keys()
    for p, v in whole.items():
        assert (v is None and small[p] is None) or math.isclose(v, small[p], rel_tol=1e-9, abs_tol=1e-9), p


def test_window_means_and_percentiles():
    z = np.random.default_rng(1).random((9, 9)) + 1e6
    z[2, 2] = np.nan
    got, rank = relief.mean(z, 2), relief.percentile(z, 2)
    for i in range(9):
        for j in range(9):
            w = z[max(i - 2, 0) : i + 3, max(j - 2, 0) : j + 3]
            w = w[np.isfinite(w)]
            if (i, j) != (2, 2):
                assert math.isclose(got[i, j], w.mean(), rel_tol=1e-12)
                assert math.isclose(rank[i, j], 100 * (w < z[i, j]).mean())


def test_quadratic_is_exact():
    y, x = np.mgrid[0:7, 0:7].astype(float)
    y = -y
    got = relief.quadratic(0.5 * x * x - 0.25 * y * y + 0.1 * x * y + 2 * x, 1)
    d, e = 3 + 0.1 * -3 + 2, -0.5 * -3 + 0.1 * 3
    assert got["slope"][3, 3] == pytest.approx(math.degrees(math.atan(math.hypot(d, e))))
    assert got["mean"][3, 3] == pytest.approx(-0.25)


def test_landforms():
    y, x = np.mgrid[-6:7, -6:7].astype(float)
    forms = lambda z: relief.geomorphons(z, 5, 1.0, 0, True)[6, 6]
    assert [forms(z) for z in (0 * x, -np.hypot(x, y), np.hypot(x, y), -np.abs(x) * 2, np.abs(x) * 2)] == [1, 2, 10, 3, 9]


def test_sight_over_a_wall():
    z = np.zeros((5, 9))
    z[:, 4] = 10
    seen = relief.sight(z, 2, 1, 2.0, 20)
    assert seen[2, 2] and seen[2, 4] and not seen[2, 6]
    assert relief.fetch(z, 90.0, 0.0, 8)[2, 1] == 1 and relief.fetch(z, 90.0, 0.5, 8)[2, 1] == 3


def test_plane_keeps_its_shape():
    y, x = np.mgrid[0:25, 0:25].astype(float)
    z = 0.3 * x - 0.2 * y
    assert np.allclose(relief.smoothed(z, 2, 15.0, 3, 0.5)[8:-8, 8:-8], z[8:-8, 8:-8])
    assert relief.normal_deviation(z, 2)[12, 12] == pytest.approx(0, abs=1e-5)
