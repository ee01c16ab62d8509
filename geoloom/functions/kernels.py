"""Filter kernels, row by row from the upper left."""

from __future__ import annotations

from math import exp, pi, sqrt

# Weights that results depend on.
LAPLACIAN = {
    "3x3(1)": [0, -1, 0, -1, 4, -1, 0, -1, 0],
    "3x3(2)": [0, -1, 0, -1, 5, -1, 0, -1, 0],
    "3x3(3)": [-1, -1, -1, -1, 8, -1, -1, -1, -1],
    "3x3(4)": [1, -2, 1, -2, 4, -2, 1, -2, 1],
    "5x5(1)": [0, 0, -1, 0, 0, 0, -1, -2, -1, 0, -1, -2, 17, -2, -1, 0, -1, -2, -1, 0, 0, 0, -1, 0, 0],
}
EMBOSS = {
    "n": [0, -1, 0, 0, 0, 0, 0, 1, 0],
    "s": [0, 1, 0, 0, 0, 0, 0, -1, 0],
    "e": [0, 0, 0, 1, 0, -1, 0, 0, 0],
    "w": [0, 0, 0, -1, 0, 1, 0, 0, 0],
    "ne": [0, 0, -1, 0, 0, 0, 1, 0, 0],
    "nw": [-1, 0, 0, 0, 0, 0, 0, 0, 1],
    "se": [1, 0, 0, 0, 0, 0, 0, 0, -1],
    "sw": [0, 0, 1, 0, 0, 0, -1, 0, 0],
}
LINES = {
    "vertical": [-1, 2, -1, -1, 2, -1, -1, 2, -1],
    "horizontal": [-1, -1, -1, 2, 2, 2, -1, -1, -1],
    "135": [2, -1, -1, -1, 2, -1, -1, -1, 2],
    "45": [-1, -1, 2, -1, 2, -1, 2, -1, -1],
}
SOBEL_X, SOBEL_Y = [-1, 0, 1, -2, 0, 2, -1, 0, 1], [1, 2, 1, 0, 0, 0, -1, -2, -1]
PREWITT_X, PREWITT_Y = [-1, 0, 1, -1, 0, 1, -1, 0, 1], [1, 1, 1, 0, 0, 0, -1, -1, -1]
SCHARR_X, SCHARR_Y = [3, 0, -3, 10, 0, -10, 3, 0, -3], [3, 10, 3, 0, 0, 0, -3, -10, -3]

# Derivatives of a third-order polynomial fitted to 5x5 cells: of x, of y (north up),
# and the second ones of x twice, y twice and both; to be divided by 420, 420, 35, 35 and 100.
DX = [31, -44, 0, 44, -31, -5, -62, 0, 62, 5, -17, -68, 0, 68, 17, -5, -62, 0, 62, 5, 31, -44, 0, 44, -31]
DY = [-31, 5, 17, 5, -31, 44, 62, 68, 62, 44, 0, 0, 0, 0, 0, -44, -62, -68, -62, -44, 31, -5, -17, -5, 31]
DXX = [2, -1, -2, -1, 2] * 5
DYY = [w for w in (2, -1, -2, -1, 2) for _ in range(5)]
DXY = [dy * dx for dy in range(-2, 3) for dx in range(-2, 3)]


def reach(sigma: float) -> int:
    """Cells on either side of a Gaussian kernel: where its value falls to 0.001."""
    k = 1
    while exp(-k * k / (2 * sigma * sigma)) / (sqrt(2 * pi) * sigma) > 0.001:
        k += 1
    return k


def gaussian(sigma: float) -> list[float]:
    r = reach(sigma)
    return [exp(-(x * x + y * y) / (2 * sigma * sigma)) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def laplacian_of_gaussian(sigma: float) -> list[float]:
    r, s2 = reach(sigma), 2 * sigma * sigma
    return [-(1 - (x * x + y * y) / s2) * exp(-(x * x + y * y) / s2) / (pi * sigma**4) for y in range(-r, r + 1) for x in range(-r, r + 1)]
