"""Geometry in Python workers: rings as arrays of points; no Spark objects here."""

from __future__ import annotations

from math import atan2, cos, degrees, hypot, pi, sin

Point = tuple[float, float]


def hull(points: list[Point]) -> list[Point]:
    """Convex hull, counter-clockwise from the lowest-leftmost point, not closed."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq: list[Point]) -> list[Point]:
        out: list[Point] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def area(ring: list[Point]) -> float:
    """Signed area of a ring, closed or not."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def bounding_box(points: list[Point], criterion: str = "area") -> tuple[list[Point], float, float, float]:
    """Least bounding rectangle over the directions of the hull's edges: corners, long side, short side, direction of the long side (radians)."""
    h = hull(points)
    if len(h) < 3:
        (x0, y0), (x1, y1) = h[0], h[-1]
        return [h[0], h[-1]], hypot(x1 - x0, y1 - y0), 0.0, atan2(y1 - y0, x1 - x0) % pi
    best = None
    for a, b in zip(h, h[1:] + h[:1], strict=True):
        t = atan2(b[1] - a[1], b[0] - a[0])
        c, s = cos(t), sin(t)
        u = [x * c + y * s for x, y in h]
        v = [y * c - x * s for x, y in h]
        w, d = max(u) - min(u), max(v) - min(v)
        size = {"area": w * d, "perimeter": w + d, "length": max(w, d), "width": min(w, d)}[criterion]
        if best is None or size < best[0] - 1e-12:
            corners = [(p * c - q * s, p * s + q * c) for p, q in ((min(u), min(v)), (max(u), min(v)), (max(u), max(v)), (min(u), max(v)))]
            best = size, corners, max(w, d), min(w, d), (t if w >= d else t + pi / 2) % pi
    return best[1:]


def enclosing_circle(points: list[Point]) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around the points."""
    p = hull(points)

    def inside(c: tuple[float, float, float] | None, q: Point) -> bool:
        return c is not None and hypot(q[0] - c[0], q[1] - c[1]) <= c[2] * (1 + 1e-12) + 1e-12

    def two(a: Point, b: Point) -> tuple[float, float, float]:
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, hypot(a[0] - b[0], a[1] - b[1]) / 2

    def three(a: Point, b: Point, c: Point) -> tuple[float, float, float] | None:
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-15:
            return None
        x = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        y = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return a[0] + x, a[1] + y, hypot(x, y)

    circle = (p[0][0], p[0][1], 0.0)
    for i, a in enumerate(p):
        if inside(circle, a):
            continue
        circle = (a[0], a[1], 0.0)
        for j, b in enumerate(p[:i]):
            if inside(circle, b):
                continue
            circle = two(a, b)
            for c in p[:j]:
                if not inside(circle, c):
                    circle = three(a, b, c) or circle
    return circle


def compass(radians: float) -> float:
    """Degrees clockwise from north, 0 to 180, of an axis."""
    return (90 - degrees(radians)) % 180
