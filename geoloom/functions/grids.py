"""Functions on whole arrays of cells, for tiles in Python workers; no Spark objects here."""

from __future__ import annotations

import heapq

import numpy as np

#: Neighbours in the order NE, E, SE, S, SW, W, NW, N: row step, column step, place in the 3x3 array.
AROUND = [(-1, 1, 2), (0, 1, 5), (1, 1, 8), (1, 0, 7), (1, -1, 6), (0, -1, 3), (-1, -1, 0), (-1, 0, 1)]


def flood(z: np.ndarray, w: np.ndarray, increment: float) -> np.ndarray:
    """Least flood level of each cell given the levels ``w`` known so far (infinite: unknown): a priority flood."""
    rows, cols = z.shape
    out = w.copy()
    heap = [(out[r, c], r, c) for r, c in zip(*np.nonzero(np.isfinite(out)), strict=True)]
    heapq.heapify(heap)
    while heap:
        level, r, c = heapq.heappop(heap)
        if level > out[r, c]:
            continue
        for dr, dc, _ in AROUND:
            y, x = r + dr, c + dc
            if 0 <= y < rows and 0 <= x < cols and not np.isnan(z[y, x]):
                new = max(z[y, x], level + increment)
                if new < out[y, x]:
                    out[y, x] = new
                    heapq.heappush(heap, (new, y, x))
    return out


def spread(cost: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Least accumulated cost of each cell: a step costs the mean of the two cells times its length."""
    rows, cols = cost.shape
    out = known.copy()
    heap = [(out[r, c], r, c) for r, c in zip(*np.nonzero(np.isfinite(out)), strict=True)]
    heapq.heapify(heap)
    while heap:
        total, r, c = heapq.heappop(heap)
        if total > out[r, c] or np.isnan(cost[r, c]):
            continue
        for dr, dc, _ in AROUND:
            y, x = r + dr, c + dc
            if 0 <= y < rows and 0 <= x < cols and not np.isnan(cost[y, x]):
                new = total + (cost[r, c] + cost[y, x]) / 2 * (2**0.5 if dr and dc else 1.0)
                if new < out[y, x]:
                    out[y, x] = new
                    heapq.heappush(heap, (new, y, x))
    return out


def horizon(z: np.ndarray, azimuth: float, reach: int) -> np.ndarray:
    """Largest angle (degrees, 0 at least) to the cells within ``reach`` steps towards ``azimuth``."""
    dy, dx = -np.cos(np.radians(azimuth)), np.sin(np.radians(azimuth))
    top = np.zeros_like(z)
    for k in range(1, reach + 1):
        sy, sx = int(round(dy * k)), int(round(dx * k))
        away = shifted(z, sy, sx)
        angle = np.degrees(np.arctan((away - z) / np.hypot(sy, sx)))
        top = np.fmax(top, np.nan_to_num(angle, nan=0.0))
    return np.where(np.isnan(z), np.nan, top)


def shifted(z: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The value ``dy`` rows and ``dx`` columns on; NaN off the array."""
    out = np.full_like(z, np.nan)
    rows, cols = z.shape
    if abs(dy) < rows and abs(dx) < cols:
        out[max(0, -dy) : rows - max(0, dy), max(0, -dx) : cols - max(0, dx)] = z[max(0, dy) : rows + min(0, dy), max(0, dx) : cols + min(0, dx)]
    return out
