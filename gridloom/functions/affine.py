"""Affine transforms of pixel places, windows and bounds (driver-side geometry)."""

from __future__ import annotations

import math
from typing import NamedTuple


class Bounds(NamedTuple):
    left: float
    bottom: float
    right: float
    top: float


class Window(NamedTuple):
    """Rows row_start <= row < row_stop and columns likewise; may be fractional."""

    row_start: float
    row_stop: float
    col_start: float
    col_stop: float


class Affine(NamedTuple):
    """x = a * col + b * row + c; y = d * col + e * row + f, at pixel corners."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @classmethod
    def from_gdal(cls, c, a, b, f, d, e) -> "Affine":
        return cls(a, b, c, d, e, f)

    def to_gdal(self) -> tuple[float, ...]:
        return (self.c, self.a, self.b, self.f, self.d, self.e)

    def geotransform(self) -> str:
        return " ".join(str(float(v)) for v in self.to_gdal())

    def __call__(self, col, row):
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def center(self, col, row):
        return self(col + 0.5, row + 0.5)

    def inverse(self) -> "Affine":
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def shifted(self, cols: float, rows: float) -> "Affine":
        """The transform of a window that begins at (cols, rows)."""
        return self._replace(c=self.a * cols + self.b * rows + self.c, f=self.d * cols + self.e * rows + self.f)

    @property
    def rectilinear(self) -> bool:
        return self.b == 0 and self.d == 0

    @property
    def rotated(self) -> bool:
        return self.b == self.d != 0

    @property
    def resolution(self) -> tuple[float, float]:
        if self.rotated:
            return math.hypot(self.a, self.d), math.hypot(self.b, self.e)
        return self.a, self.e

    def bounds(self, width: int, height: int) -> Bounds:
        xs, ys = zip(*(self(c, r) for c in (0, width) for r in (0, height)))
        return Bounds(min(xs), min(ys), max(xs), max(ys))

    def window(self, bounds) -> Window:
        """The window of bounds in a rectilinear grid, whichever way its axes run."""
        left, bottom, right, top = bounds
        if left > right or bottom > top:
            raise ValueError(f"bounds are the wrong way round: {tuple(bounds)}")
        cols = sorted(((left - self.c) / self.a, (right - self.c) / self.a))
        rows = sorted(((top - self.f) / self.e, (bottom - self.f) / self.e))
        return Window(rows[0], rows[1], cols[0], cols[1])


IDENTITY = Affine()


def affine_to_coords(transform: Affine, width: int, height: int, x_dim: str = "x", y_dim: str = "y") -> dict[str, list]:
    """Coordinates of pixel centres: lists by dimension, or rows of xc and yc where the grid is not rectilinear."""
    if transform.rectilinear:
        return {x_dim: [transform.center(k, 0)[0] for k in range(width)], y_dim: [transform.center(0, k)[1] for k in range(height)]}
    both = [[transform.center(c, r) for c in range(width)] for r in range(height)]
    return {"xc": [[p[0] for p in row] for row in both], "yc": [[p[1] for p in row] for row in both]}


def snap(window: Window, width: int, height: int) -> Window:
    """Whole rows and columns inside the grid: starts round down, stops up."""
    low = lambda v: 0 if v < 0 else math.floor(v)
    high = lambda v, n: 0 if v < 0 else min(math.ceil(v), n)
    row, col = low(window.row_start), low(window.col_start)
    return Window(min(row, height), max(high(window.row_stop, height), min(row, height)), min(col, width), max(high(window.col_stop, width), min(col, width)))
