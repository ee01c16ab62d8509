"""Relief of whole arrays of cells, for tiles in Python workers; no Spark objects here. NaN is NoData."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from geoloom.functions.grids import AROUND, horizon, shifted


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over windows of 2·r + 1 cells, cut at the array's edges; NaN counts as 0."""
    c = np.pad(np.cumsum(np.cumsum(np.nan_to_num(a), 0), 1), ((1, 0), (1, 0)))
    lo = [np.clip(np.arange(n) - r, 0, n) for n in a.shape]
    hi = [np.clip(np.arange(n) + r + 1, 0, n) for n in a.shape]
    return c[np.ix_(hi[0], hi[1])] - c[np.ix_(lo[0], hi[1])] - c[np.ix_(hi[0], lo[1])] + c[np.ix_(lo[0], lo[1])]


def mean(z: np.ndarray, r: int) -> np.ndarray:
    """Means over the window; values are taken about the tile's mean, so high plains lose no digits."""
    base = np.nanmean(z) if np.isfinite(z).any() else 0.0
    return np.where(np.isnan(z), np.nan, box(z - base, r) / np.maximum(box(np.isfinite(z).astype(float), r), 1) + base)


def deviation(z: np.ndarray, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """(z - mean) / standard deviation over the cells that ``sums`` adds up; 0 where flat."""
    base = np.nanmean(z) if np.isfinite(z).any() else 0.0
    d = z - base
    n = np.maximum(sums(np.isfinite(d).astype(float)), 1)
    m = sums(d) / n
    s = np.sqrt(np.maximum(sums(d * d) / n - m * m, 0))
    return np.where(np.isnan(z), np.nan, np.divide(d - m, s, out=np.zeros_like(d), where=s > 1e-9))


def gradient(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rise eastward and southward by weighted differences of the eight neighbours; a missing one counts as the cell itself."""
    ne, e, se, s, sw, w, nw, n = (np.where(np.isnan(v), z, v) for v in (shifted(z, dr, dc) for dr, dc, _ in AROUND))
    gone = np.where(np.isnan(z), np.nan, 0.0)
    return (ne + 2 * e + se - nw - 2 * w - sw) / 8 + gone, (sw + 2 * s + se - nw - 2 * n - ne) / 8 + gone


def normal(z: np.ndarray) -> np.ndarray:
    """Unit normals, the three components first."""
    p, q = gradient(z)
    v = np.array([-p, -q, 1 + 0 * p])
    return v / np.sqrt((v * v).sum(axis=0))


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip((a * b).sum(axis=0), -1, 1)))


def normal_deviation(z: np.ndarray, r: int) -> np.ndarray:
    a = _angle(normal(z), normal(mean(z, r)))
    return np.where(np.isnan(z), np.nan, box(a, r) / np.maximum(box(np.isfinite(a).astype(float), r), 1))


def normal_spread(z: np.ndarray, r: int) -> np.ndarray:
    """Spherical standard deviation (degrees) of the normals of the smoothed surface."""
    v = normal(mean(z, max(r // 2, 1)))
    n = np.maximum(box(np.isfinite(v[0]).astype(float), r), 1)
    length = np.sqrt(sum(box(c, r) ** 2 for c in v)) / n
    return np.where(np.isnan(z), np.nan, np.degrees(np.sqrt(np.maximum(-2 * np.log(np.clip(length, 1e-12, 1)), 0))))


def percentile(z: np.ndarray, r: int) -> np.ndarray:
    """Percent of the window's cells below the cell."""
    below, n = np.zeros_like(z), np.zeros_like(z)
    for dr in range(-r, r + 1):
        for dc in range(-r, r + 1):
            v = shifted(z, dr, dc)
            below += v < z
            n += np.isfinite(v)
    return np.where(np.isnan(z), np.nan, 100 * below / np.maximum(n, 1))


def anisotropy(z: np.ndarray, r: int) -> np.ndarray:
    """Root of the mean squared gap between the deviation in the window and in each of four panels of three blocks along an axis."""
    whole = deviation(z, lambda a: box(a, r))
    k = max(r // 3, 1)
    gaps = np.zeros_like(z)
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):

        def panel(a: np.ndarray, dr: int = dr, dc: int = dc) -> np.ndarray:
            b = box(a, k)
            on, back = shifted(b, dr * 2 * k, dc * 2 * k), shifted(b, -dr * 2 * k, -dc * 2 * k)
            return b + np.nan_to_num(on) + np.nan_to_num(back)

        gaps = gaps + (deviation(z, panel) - whole) ** 2
    return np.sqrt(gaps / 4)


def edge_density(z: np.ndarray, r: int, norm_diff: float) -> np.ndarray:
    v = normal(z)
    edge = np.zeros(z.shape)
    for dr, dc, _ in AROUND:
        other = np.array([shifted(c, dr, dc) for c in v])
        edge = np.maximum(edge, _angle(v, other) > norm_diff)
    edge = np.where(np.isnan(z), np.nan, edge)
    return np.where(np.isnan(z), np.nan, box(edge, r) / np.maximum(box(np.isfinite(z).astype(float), r), 1))


def smoothed(z: np.ndarray, r: int, norm_diff: float, iterations: int, max_diff: float) -> np.ndarray:
    """Normals averaged by how near they are in direction, then elevations that follow the neighbours' planes."""
    limit = np.cos(np.radians(norm_diff))
    v = normal(z)
    total = np.zeros_like(v)
    for dr in range(-r, r + 1):
        for dc in range(-r, r + 1):
            o = np.array([shifted(c, dr, dc) for c in v])
            like = (o * v).sum(axis=0)
            w = np.where(like > limit, (like - limit) ** 2, 0.0)
            total += np.nan_to_num(o * w)
    size = np.sqrt((total * total).sum(axis=0))
    v = np.where(size > 0, total / np.where(size > 0, size, 1), v)
    out = z.copy()
    for _ in range(iterations):
        level, weight = np.zeros_like(z), np.zeros_like(z)
        for dr, dc, _at in AROUND:
            o = np.array([shifted(c, dr, dc) for c in v])
            like = (o * v).sum(axis=0)
            w = np.where(like > limit, (like - limit) ** 2, 0.0)
            # the neighbour's plane at the cell, dc west and dr north of it
            at = shifted(out, dr, dc) + (o[0] * dc + o[1] * dr) / o[2]
            good = np.isfinite(at) & (w > 0)
            level += np.where(good, at * w, 0.0)
            weight += np.where(good, w, 0.0)
        new = np.where(weight > 0, level / np.where(weight > 0, weight, 1), out)
        out = np.where(np.abs(new - z) <= max_diff, new, out)
    return np.where(np.isnan(z), np.nan, out)


def gaps_filled(z: np.ndarray, r: int, weight: float, no_edges: bool) -> np.ndarray:
    top, total = np.zeros_like(z), np.zeros_like(z)
    sides = {k: np.zeros(z.shape, bool) for k in ("n", "s", "w", "e")}
    for dr in range(-r, r + 1):
        for dc in range(-r, r + 1):
            if (dr or dc) and dr * dr + dc * dc <= r * r:
                v = shifted(z, dr, dc)
                there = np.isfinite(v)
                w = (dr * dr + dc * dc) ** (-weight / 2)
                top += np.where(there, v, 0.0) * w
                total += there * w
                if not dr or not dc:
                    sides["n" if dr < 0 else "s" if dr > 0 else "w" if dc < 0 else "e"] |= there
    good = np.isnan(z) & (total > 0)
    if no_edges:
        good &= (sides["n"] & sides["s"]) | (sides["w"] & sides["e"])
    return np.where(good, top / np.where(total > 0, total, 1), z)


def _extreme(z: np.ndarray, r: int, pick: Callable) -> np.ndarray:
    out = z
    for axis in (0, 1):
        parts = [shifted(out, k if axis == 0 else 0, k if axis == 1 else 0) for k in range(-r, r + 1)]
        out = pick.reduce(parts)
    return out


def without_objects(z: np.ndarray, r: int, slope: float) -> np.ndarray:
    opened = _extreme(_extreme(z, r, np.fmin), r, np.fmax)
    tall = z - opened > np.tan(np.radians(slope))
    steep = np.zeros(z.shape, bool)
    for dr, dc, _ in AROUND:
        steep |= z - shifted(z, dr, dc) > np.tan(np.radians(slope)) * np.hypot(dr, dc)
    # an object is what is connected to a steep side through tall cells, within the window
    seen = tall & steep
    for _ in range(2 * r):
        grown = seen.copy()
        for dr, dc, _at in AROUND:
            grown |= shifted(seen.astype(float), dr, dc) == 1
        seen = grown & tall
    return np.where(seen, opened, z)


def quadratic(z: np.ndarray, r: int) -> dict[str, np.ndarray]:
    """Least squares of a·x² + b·y² + c·x·y + d·x + e·y + f (x east, y north) about each cell; missing cells count as the cell itself."""
    side = range(-r, r + 1)
    x = np.array([(dc, -dr) for dr in side for dc in side], float)
    design = np.column_stack([x[:, 0] ** 2, x[:, 1] ** 2, x[:, 0] * x[:, 1], x[:, 0], x[:, 1], np.ones(len(x))])
    solve = np.linalg.pinv(design)
    fit = np.zeros((6, *z.shape))
    for i, (dr, dc) in enumerate((dr, dc) for dr in side for dc in side):
        v = shifted(z, dr, dc)
        fit += solve[:, i, None, None] * np.where(np.isnan(v), z, v)
    a, b, c, d, e, _ = fit
    g = d * d + e * e
    safe = np.where(g > 1e-12, g, 1.0)
    profile = np.where(g > 1e-12, -2 * (a * d * d + b * e * e + c * d * e) / (safe * (1 + g) ** 1.5), 0.0)
    plan = np.where(g > 1e-12, 2 * (b * d * d + a * e * e - c * d * e) / safe**1.5, 0.0)
    nan = np.isnan(z)
    out = {"slope": np.degrees(np.arctan(np.sqrt(g))), "aspect": np.where(g > 1e-12, np.degrees(np.arctan2(-d, -e)) % 360, -1.0), "profile": profile, "plan": plan, "mean": -(a + b)}
    return {k: np.where(nan, np.nan, v) for k, v in out.items()}


def gaussian(z: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    top, low = np.nan_to_num(z), np.isfinite(z).astype(float)
    for axis in (0, 1):
        step = lambda a, axis=axis: sum(np.nan_to_num(shifted(a, i if axis == 0 else 0, i if axis == 1 else 0)) * w for i, w in zip(range(-r, r + 1), k, strict=True))
        top, low = step(top), step(low)
    return np.where(np.isnan(z), np.nan, top / np.where(low > 0, low, 1))


def slope(z: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan(np.hypot(*gradient(z))))


SURFACES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "elevation": lambda z: z,
    "slope": slope,
    "eastness": lambda z: -np.sin(np.arctan2(*gradient(z))),
    "northness": lambda z: np.cos(np.arctan2(*gradient(z))),
    "mean_curvature": lambda z: quadratic(z, 1)["mean"],
}


# rays


def _step(azimuth: float, k: int) -> tuple[int, int]:
    return int(round(-np.cos(np.radians(azimuth)) * k)), int(round(np.sin(np.radians(azimuth)) * k))


def ray_relief(z: np.ndarray, azimuth: float, reach: int) -> np.ndarray:
    total, n = np.zeros_like(z), np.zeros_like(z)
    for k in range(1, reach + 1):
        v = shifted(z, *_step(azimuth, k))
        total += np.nan_to_num(v)
        n += np.isfinite(v)
    return np.where(n > 0, total / np.maximum(n, 1) - z, z * 0)


def fetch(z: np.ndarray, azimuth: float, increment: float, reach: int) -> np.ndarray:
    out, far, open_ = np.full(z.shape, np.nan), np.zeros(z.shape), np.isfinite(z)
    for k in range(1, reach + 1):
        dr, dc = _step(azimuth, k)
        d = float(np.hypot(dr, dc))
        v = shifted(z, dr, dc)
        hit = open_ & (v >= z + d * increment)
        out[hit] = d
        open_ &= ~hit & np.isfinite(v)
        far[open_] = d
    return np.where(np.isnan(z), np.nan, np.where(np.isnan(out), -far, out))


def wind_exposure(z: np.ndarray, azimuth: float, reach: int) -> np.ndarray:
    p, q = gradient(z)
    steep, facing = np.arctan(np.hypot(p, q)), np.arctan2(-p, q)
    level = np.radians(90 - horizon(z, azimuth, reach))  # of the sky's rim, from the zenith
    flux = np.cos(steep) * np.cos(np.pi / 2 - level) + np.sin(steep) * np.sin(np.pi / 2 - level) * np.cos(np.radians(azimuth) - facing)
    return np.where(np.isnan(z), np.nan, flux)


#: Landforms by the number of lower (rows) and higher (columns) lines of sight, fixed values: 1 flat, 2 peak, 3 ridge, 4 shoulder, 5 spur, 6 slope, 7 hollow, 8 footslope, 9 valley, 10 pit.
FORMS = [
    [1, 1, 1, 8, 8, 9, 9, 9, 10],
    [1, 1, 8, 8, 8, 9, 9, 9],
    [1, 4, 6, 6, 7, 7, 9],
    [4, 4, 6, 6, 6, 7],
    [4, 4, 5, 6, 6],
    [3, 3, 5, 5],
    [3, 3, 3],
    [3, 3],
    [2],
]


def geomorphons(z: np.ndarray, search: int, threshold: float, skip: int, forms: bool) -> np.ndarray:
    higher, lower, code = np.zeros(z.shape, int), np.zeros(z.shape, int), np.zeros(z.shape)
    for i, (dr, dc, _) in enumerate(AROUND):
        up, down = np.full(z.shape, -np.inf), np.full(z.shape, np.inf)
        for k in range(skip + 1, search + 1):
            if k * np.hypot(dr, dc) > search:
                break
            a = np.degrees(np.arctan((shifted(z, dr * k, dc * k) - z) / (k * np.hypot(dr, dc))))
            up, down = np.fmax(up, a), np.fmin(down, a)
        # the nadir angle less the zenith angle of the line is the sum of its steepest rise and fall
        gap = np.where(np.isfinite(up), up + np.where(np.isfinite(down), down, 0.0), 0.0)
        plus, minus = gap > threshold, gap < -threshold
        higher += plus
        lower += minus
        code += 3.0**i * np.where(plus, 2, np.where(minus, 0, 1))
    if not forms:
        return np.where(np.isnan(z), np.nan, code)
    table = np.zeros((9, 9))
    for i, row in enumerate(FORMS):
        table[i, : len(row)] = row
    return np.where(np.isnan(z), np.nan, table[lower, higher])


def sun_positions(latitude: float, days: Sequence[int], hours: Sequence[float]) -> list[tuple[float, float]]:
    """(azimuth, altitude) in degrees of the sun while it is up."""
    out, lat = [], np.radians(latitude)
    for day in days:
        tilt = np.radians(23.45 * np.sin(2 * np.pi * (284 + day) / 365))
        for hour in hours:
            turn = np.radians(15 * (hour - 12))
            up = np.arcsin(np.sin(lat) * np.sin(tilt) + np.cos(lat) * np.cos(tilt) * np.cos(turn))
            if up > 0:
                az = np.arctan2(np.sin(turn), np.cos(turn) * np.sin(lat) - np.tan(tilt) * np.cos(lat))
                out.append((float(np.degrees(az) + 180) % 360, float(np.degrees(up))))
    return out


def daylight(z: np.ndarray, sun: list[tuple[float, float]], az_step: float, reach: int) -> np.ndarray:
    lit, known = np.zeros(z.shape), {}
    for az, up in sun:
        k = round(az / az_step) % max(int(round(360 / az_step)), 1)
        if k not in known:
            known[k] = horizon(z, k * az_step, reach)
        lit += known[k] < up
    return np.where(np.isnan(z), np.nan, lit / max(len(sun), 1))


def sight(z: np.ndarray, r: int, c: int, height: float, reach: int) -> np.ndarray:
    """Whether each cell within ``reach`` is seen from (r, c): no cell on the line is above the line of sight."""
    rows, cols = z.shape
    r0, r1, c0, c1 = max(r - reach, 0), min(r + reach + 1, rows), max(c - reach, 0), min(c + reach + 1, cols)
    y, x = np.mgrid[r0:r1, c0:c1]
    dy, dx = y - r, x - c
    n = np.maximum(np.maximum(np.abs(dy), np.abs(dx)), 1)
    d = np.hypot(dy, dx)
    eye = z[r, c] + height
    slope = (z[r0:r1, c0:c1] - eye) / np.maximum(d, 1e-9)
    top = np.full(d.shape, -np.inf)
    for k in range(1, int(n.max())):
        part = k < n
        yy, xx = (np.where(part, np.rint(v), o).astype(int) for v, o in ((r + dy * k / n, r), (c + dx * k / n, c)))
        on = (z[yy, xx] - eye) / np.maximum(np.hypot(yy - r, xx - c), 1e-9)
        top = np.where(part, np.fmax(top, on), top)
    out = np.zeros(z.shape, bool)
    out[r0:r1, c0:c1] = (slope >= top) & (d <= reach) & np.isfinite(z[r0:r1, c0:c1])
    out[r, c] = True
    return out


def seen_from(z: np.ndarray, stations: list[tuple[int, int]], height: float, reach: int) -> np.ndarray:
    total = np.zeros(z.shape)
    for r, c in stations:
        if 0 <= r < z.shape[0] and 0 <= c < z.shape[1] and np.isfinite(z[r, c]):
            total += sight(z, r, c, height, reach)
    return np.where(np.isnan(z), np.nan, total)


def visibility(z: np.ndarray, height: float, step: int, reach: int) -> np.ndarray:
    """Share of sampled targets in reach that a cell sees, by lines to each target offset in turn."""
    seen, n = np.zeros(z.shape), np.zeros(z.shape)
    eye = z + height
    for dr in range(-reach, reach + 1, step):
        for dc in range(-reach, reach + 1, step):
            d = float(np.hypot(dr, dc))
            if not d or d > reach:
                continue
            m = max(abs(dr), abs(dc))
            target = shifted(z, dr, dc)
            top = np.full(z.shape, -np.inf)
            for k in range(1, m):
                y, x = int(round(dr * k / m)), int(round(dc * k / m))
                top = np.fmax(top, (shifted(z, y, x) - eye) / np.hypot(y, x))
            there = np.isfinite(target)
            n += there
            seen += there & ((target - eye) / d >= top)
    return np.where(np.isnan(z), np.nan, seen / np.maximum(n, 1))
