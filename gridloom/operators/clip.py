"""Clipping by polygons: a cell's centre inside (or, if asked, a cell that an edge touches).

Vertices go to pixel space on the driver, so the test is the same for sheared
grids and needs only integer row and col; the polygons' box goes to the scan as
a filter.  What of the grid remains is found from the geometry alone, row by
row, without reading cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridloom.errors import NoCellsInBounds
from gridloom.functions import crs as crs_lib
from gridloom.functions import geometry as geo
from gridloom.functions.affine import Window
from gridloom.operators.select import cut
from gridloom.plans.grid import Grid


def _window(polygons, meta, all_touched: bool, invert: bool) -> Window | None:
    """The smallest window of the kept cells, from spans of each row; none if nothing is kept."""
    boxes = [geo.pixel_box(p, meta.width, meta.height) for p in polygons]
    first, last = min(b[0] for b in boxes), max(b[1] for b in boxes)
    rows, cols = [], []
    for row in range(0 if invert else max(first, 0), meta.height if invert else max(last, first)):
        spans = sorted(s for p in polygons for s in geo.row_spans(p, row, meta.width, all_touched)) if first <= row < last else []
        if invert:
            gaps, at = [], 0
            for a, b in spans:
                if a > at:
                    gaps.append((at, a))
                at = max(at, b)
            spans = gaps + ([(at, meta.width)] if at < meta.width else [])
            if spans and (spans[0][0], spans[-1][1]) == (0, meta.width) and not (first <= row < last):
                rows += [0 if row < first else row, first - 1 if row < first else meta.height - 1]
                cols += [0, meta.width]
                continue
        if spans:
            rows.append(row)
            cols += [spans[0][0], max(s[1] for s in spans)]
    return Window(min(rows), max(rows) + 1, min(cols), max(cols)) if rows else None


def clip(grid: Grid, geometries, crs=None, *, all_touched=False, drop=True, invert=False, from_disk=False) -> Grid:
    """Cells in any of the geometries (outside all, with ``invert``); others become missing.

    ``drop`` cuts the grid to the kept cells' window.  ``from_disk`` changes
    nothing: the box always reaches the scan.
    """
    m = grid.meta
    polygons = [p for g in geometries for p in geo.polygons(g)]
    if crs is not None and (src := crs_lib.parse_crs(crs)) != m.need_crs():
        polygons = [[[tuple(map(float, crs_lib.transform(src, m.crs, *p))) for p in ring] for ring in polygon] for polygon in polygons]
    polygons = [geo.to_pixels(p, m.transform) for p in polygons]
    window = _window(polygons, m, all_touched, invert)
    if window is None:
        raise NoCellsInBounds("no cell lies in the geometries")
    row, col = F.col("row"), F.col("col")

    def one(p):
        r0, r1, c0, c1 = geo.pixel_box(p, m.width, m.height)
        test = geo.inside(p, col + F.lit(0.5), row + F.lit(0.5))
        if all_touched:
            test = test | geo.touched(p, col, row)
        return (row >= r0) & (row < r1) & (col >= c0) & (col < c1) & test

    keep = reduce(lambda a, b: a | b, map(one, polygons))
    if invert:
        keep = ~keep
    nodata = m.found_nodata()
    value = grid.value
    fill = F.lit(nodata if nodata is not None and nodata == nodata else None).cast(dict(grid.df.dtypes)[value])
    df = grid.df
    if drop:  # the window as bare comparisons, which reach the scan
        df = df.where((row >= window.row_start) & (row < window.row_stop) & (col >= window.col_start) & (col < window.col_stop))
    missing = F.col(value).isNull() | F.isnan(value) if m.dtype.startswith("float") else F.col(value).isNull()
    df = df.withColumn(value, F.when(keep & ~missing, F.col(value)).otherwise(fill))
    return cut(Grid(df, m), window) if drop else Grid(df, m)
