"""Polygons against cells: Column expressions in pixel space, and row spans on the driver.

A geometry is a GeoJSON-like mapping, an object with ``__geo_interface__``, or
a list of rings.  A ring is closed if it is not already.  Points inside are
found by the even-odd rule with half-open edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.affine import Affine

#: Polygons with more edges than this are evaluated from an array literal, not unrolled.
UNROLLED = 64


def polygons(geometry) -> list[list[list[tuple[float, float]]]]:
    """Polygons as lists of rings of points."""
    if hasattr(geometry, "__geo_interface__"):
        geometry = geometry.__geo_interface__
    if isinstance(geometry, dict):
        kind = geometry["type"]
        if kind == "Polygon":
            return [[[tuple(p[:2]) for p in ring] for ring in geometry["coordinates"]]]
        if kind == "MultiPolygon":
            return [[[tuple(p[:2]) for p in ring] for ring in part] for part in geometry["coordinates"]]
        if kind == "Feature":
            return polygons(geometry["geometry"])
        if kind in ("FeatureCollection", "GeometryCollection"):
            return [p for g in geometry.get("features", geometry.get("geometries")) for p in polygons(g)]
        raise ValueError(f"geometries of type {kind!r} have no area")
    return [[[tuple(p[:2]) for p in ring] for ring in geometry]]


def edges(polygon) -> list[tuple[float, float, float, float]]:
    out = []
    for ring in polygon:
        ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out += [(*p, *q) for p, q in zip(ring, ring[1:])]
    return out


def to_pixels(polygon, transform: Affine) -> list[list[tuple[float, float]]]:
    """Rings in (col, row) places of a grid."""
    inverse = transform.inverse()
    return [[inverse(*p) for p in ring] for ring in polygon]


def _crosses(x1, y1, x2, y2, x, y):
    """Whether a ray to the right of (x, y) crosses an edge."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def _touches(x1, y1, x2, y2, col, row, least, greatest):
    """Whether an edge meets the open cell [col, col + 1] x [row, row + 1] (clipping by slabs)."""

    def slab(p, q, low):
        return (low - p) / (q - p), (low + 1 - p) / (q - p)

    near, far, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q, low in ((x1, x2, col), (y1, y2, row)):
        a, b = slab(p, q, low)
        flat = q == p
        if isinstance(flat, bool):
            if flat:
                out = out | (low >= p) | (low + 1 <= p)
                continue
            near.append(least(a, b))
            far.append(greatest(a, b))
        else:
            out = out | (flat & ((low >= p) | (low + 1 <= p)))
            near.append(F.when(~flat, least(a, b)).otherwise(0.0))
            far.append(F.when(~flat, greatest(a, b)).otherwise(1.0))
    return ~out & (greatest(*near) < least(*far))


def inside(polygon, x: Column, y: Column) -> Column:
    """Whether (x, y) lies in a polygon with holes."""
    found = edges(polygon)
    if len(found) <= UNROLLED:
        count = None
        for x1, y1, x2, y2 in found:
            if y1 != y2:
                one = F.when(_crosses(F.lit(float(x1)), F.lit(float(y1)), F.lit(float(x2)), F.lit(float(y2)), x, y), 1).otherwise(0)
                count = one if count is None else count + one
        return F.lit(False) if count is None else F.pmod(count, F.lit(2)) == 1
    all_edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in found if e[1] != e[3]])
    count = F.aggregate(all_edges, F.lit(0), lambda n, e: n + F.when(_crosses(e["x1"], e["y1"], e["x2"], e["y2"], x, y), 1).otherwise(0))
    return F.pmod(count, F.lit(2)) == 1


def touched(polygon, col: Column, row: Column) -> Column:
    """Whether any edge of a polygon (in pixel space) passes through the cell."""
    found = edges(polygon)
    col, row = col.cast("double"), row.cast("double")
    if len(found) <= UNROLLED:
        out = F.lit(False)
        for e in found:
            out = out | _touches(*map(float, e), col, row, F.least, F.greatest)
        return out
    all_edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in found])
    return F.exists(all_edges, lambda e: _touches(e["x1"], e["y1"], e["x2"], e["y2"], col, row, F.least, F.greatest))


def pixel_box(polygon, width: int, height: int) -> tuple[int, int, int, int]:
    """(row_start, row_stop, col_start, col_stop) around rings in pixel space, within the grid."""
    xs, ys = [p[0] for r in polygon for p in r], [p[1] for r in polygon for p in r]
    return max(math.floor(min(ys)), 0), min(math.ceil(max(ys)), height), max(math.floor(min(xs)), 0), min(math.ceil(max(xs)), width)


def row_spans(polygon, row: int, width: int, all_touched: bool = False) -> list[tuple[int, int]]:
    """Columns [start, stop) of a row whose centres lie inside (or that edges touch), from rings in pixel space."""
    y, cuts, spans = row + 0.5, [], []
    for x1, y1, x2, y2 in edges(polygon):
        if (y1 > y) != (y2 > y):
            cuts.append((x2 - x1) * (y - y1) / (y2 - y1) + x1)
        if all_touched:
            low, high = sorted((y1, y2))
            if low < row + 1 and high > row or low == high and row < low < row + 1:
                at = lambda v: x1 if y1 == y2 else x1 + (x2 - x1) * (v - y1) / (y2 - y1)  # noqa: E731, B023
                ends = (x1, x2) if y1 == y2 else (at(max(low, row)), at(min(high, row + 1)))
                a, b = math.floor(min(ends)), math.ceil(max(ends))
                spans.append((max(a, 0), min(max(b, a + 1), width)))
    cuts.sort()
    for a, b in zip(cuts[::2], cuts[1::2]):  # a centre c is inside if a <= c < b is false only outside: crossings to its right are odd
        spans.append((max(math.ceil(a - 0.5), 0), min(math.ceil(b - 0.5), width)))
    return [s for s in spans if s[0] < s[1]]
