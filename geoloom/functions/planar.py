"""Boolean operations on polygons in Python workers: edges split at their crossings, kept by what lies on their sides.

A polygon is a list of rings (lists of points, closed or not), inside by parity. No Spark objects here.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from math import atan2, hypot, pi

Point = tuple[float, float]
Rings = list[list[Point]]
#: Coordinates are rounded to so many digits, which makes crossings of the same edges one point.
DIGITS = 9


def _edges(rings: Rings) -> list[tuple[Point, Point]]:
    out = []
    for ring in rings:
        pts = [(round(x, DIGITS), round(y, DIGITS)) for x, y in ring]
        out += [(a, b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True) if a != b]
    return out


def inside(p: Point, rings: Rings) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in _edges(rings):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def _cuts(e: tuple[Point, Point], others: list[tuple[Point, Point]]) -> list[float]:
    """Places along ``e`` (0 to 1) where other edges cross or touch it."""
    (x1, y1), (x2, y2) = e
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    out = {0.0, 1.0}
    lo_x, hi_x, lo_y, hi_y = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
    for (x3, y3), (x4, y4) in others:
        if max(x3, x4) < lo_x or min(x3, x4) > hi_x or max(y3, y4) < lo_y or min(y3, y4) > hi_y:
            continue
        ex, ey = x4 - x3, y4 - y3
        d = dx * ey - dy * ex
        if abs(d) > 1e-12 * (size * (ex * ex + ey * ey)) ** 0.5:
            t = ((x3 - x1) * ey - (y3 - y1) * ex) / d
            u = ((x3 - x1) * dy - (y3 - y1) * dx) / d
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                out.add(min(max(t, 0.0), 1.0))
        for x, y in ((x3, y3), (x4, y4)):
            t = ((x - x1) * dx + (y - y1) * dy) / size
            if 0 < t < 1 and abs((x - x1) * dy - (y - y1) * dx) <= 1e-9 * size**0.5:
                out.add(t)
    return sorted(out)


def pieces(groups: list[Rings]) -> set[tuple[Point, Point]]:
    """All edges split where any two meet; each once, from its lesser end."""
    every = [e for rings in groups for e in _edges(rings)]
    out = set()
    for e in every:
        (x1, y1), (x2, y2) = e
        at = [(round(x1 + t * (x2 - x1), DIGITS), round(y1 + t * (y2 - y1), DIGITS)) for t in _cuts(e, every)]
        for a, b in zip(at, at[1:], strict=False):
            if a != b:
                out.add((a, b) if a < b else (b, a))
    return out


def boundary(groups: list[Rings], keep: Callable[[list[bool]], bool]) -> list[tuple[Point, Point]]:
    """The directed edges, area on their left, around the points for which ``keep`` holds; it is told for each group whether a point is in it."""
    out = []
    for a, b in sorted(pieces(groups)):
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = hypot(dx, dy)
        off = min(1e-6, size / 4)
        mid = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        left = keep([inside((mid[0] - dy / size * off, mid[1] + dx / size * off), g) for g in groups])
        right = keep([inside((mid[0] + dy / size * off, mid[1] - dx / size * off), g) for g in groups])
        if left and not right:
            out.append((a, b))
        elif right and not left:
            out.append((b, a))
    return out


def chained(edges: list[tuple[Point, Point]]) -> Rings:
    """Rings of directed edges; at a point where several leave, the sharpest left turn closes the smallest ring."""
    leave = defaultdict(list)
    for a, b in edges:
        leave[a].append(b)
    out = []
    for start in sorted(leave):
        while leave[start]:
            ring, a = [start], start
            b = leave[a].pop(0)
            while b != start:
                ring.append(b)
                back = atan2(a[1] - b[1], a[0] - b[0])
                turn = lambda q, b=b, back=back: (back - atan2(q[1] - b[1], q[0] - b[0])) % (2 * pi) or 2 * pi
                nxt = min(leave[b], key=turn)
                leave[b].remove(nxt)
                a, b = b, nxt
            out.append(_simple(ring))
    return [r for r in out if len(r) > 2]


def _simple(ring: list[Point]) -> list[Point]:
    keep = []
    for i, p in enumerate(ring):
        a, b = ring[i - 1], ring[(i + 1) % len(ring)]
        if abs((p[0] - a[0]) * (b[1] - p[1]) - (p[1] - a[1]) * (b[0] - p[0])) > 1e-12:
            keep.append(p)
    return keep


def area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def polygons(rings: Rings) -> list[Rings]:
    """Hulls (counter-clockwise) each with the holes in it."""
    hulls = sorted((r for r in rings if area(r) > 0), key=area)
    out = [[h] for h in hulls]
    for hole in (r for r in rings if area(r) < 0):
        a, b = hole[0], hole[1]
        mid = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        size = hypot(b[0] - a[0], b[1] - a[1])
        p = (mid[0] - (b[1] - a[1]) / size * 1e-7, mid[1] + (b[0] - a[0]) / size * 1e-7)  # just inside the area
        for h in out:
            if inside(p, [h[0]]):
                h.append(hole)
                break
    return out


def overlay(groups: list[Rings], keep: Callable[[list[bool]], bool]) -> list[Rings]:
    return polygons(chained(boundary(groups, keep)))
