"""Growing rasters: only the new cells are made, and put beside the old ones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions.affine import Window
from gridloom.plans.grid import Grid


def frame(grid: Grid, left: int, right: int, above: int, below: int, fill=None) -> Grid:
    """Add columns and rows on each side; new cells hold ``fill``, else the missing value, else null."""
    left, right, above, below = (max(int(v), 0) for v in (left, right, above, below))
    if not left + right + above + below:
        return grid
    m = grid.meta
    meta = m.cut(Window(-above, m.height + below, -left, m.width + right))
    moved = grid.df.withColumns({"row": (F.col("row") + above).cast("int"), "col": (F.col("col") + left).cast("int")})
    nodata = m.found_nodata()
    fill = fill if fill is not None else nodata if nodata is not None and nodata == nodata else None
    row, col = F.col("row"), F.col("col")
    old = row.between(above, above + m.height - 1) & col.between(left, left + m.width - 1)
    # One range of rows, then columns, for each band: no product of two tables.
    new = grid.df.sparkSession.range(meta.height).select(F.col("id").cast("int").alias("row"))
    new = new.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(meta.width - 1)))).where(~old)
    bands = F.array(*[F.lit(b) for b in m.bands]) if len(m.bands) != m.bands[-1] else F.sequence(F.lit(1), F.lit(m.bands[-1]))
    new = new.withColumn("band", F.explode(bands))
    kinds = dict(grid.df.dtypes)
    new = new.select(*[F.col(k).cast(kinds[k]).alias(k) for k in ("band", "row", "col")], *[F.lit(fill).cast(kinds[v]).alias(v) for v in grid.values])
    return Grid(moved.select(new.columns).unionByName(new), meta)


def _steps(edge: float, bound: float, res: float) -> int:
    """How many further centres lie strictly before a bound, from the outermost centre."""
    return max(0, math.ceil((bound - edge) / res - 1e-9) - 1)


def pad_xy(grid: Grid, minx, miny, maxx, maxy, *, constant_values=None) -> Grid:
    """Grow by all centres that lie strictly within the bounds, whichever way the axes run.

    ``constant_values``: one value, or ((above, below), (left, right)) by side.
    """
    t, m = grid.meta.transform, grid.meta
    xs, ys = sorted((t.center(0, 0)[0], t.center(m.width - 1, 0)[0])), sorted((t.center(0, 0)[1], t.center(0, m.height - 1)[1]))
    west, east = _steps(-xs[0], -minx, abs(t.a)), _steps(xs[1], maxx, abs(t.a))
    south, north = _steps(-ys[0], -miny, abs(t.e)), _steps(ys[1], maxy, abs(t.e))
    left, right = (west, east) if t.a > 0 else (east, west)
    above, below = (north, south) if t.e < 0 else (south, north)
    if isinstance(constant_values, dict):
        constant_values = (constant_values.get(m.y_dim), constant_values.get(m.x_dim))
    if isinstance(constant_values, (tuple, list)):
        pair = lambda v: v if isinstance(v, (tuple, list)) else (v, v)
        rows, cols = (pair(v) for v in constant_values)
        out = frame(frame(grid, 0, 0, above, 0, rows[0]), 0, 0, 0, below, rows[1])
        return frame(frame(out, left, 0, 0, 0, cols[0]), 0, right, 0, 0, cols[1])
    return frame(grid, left, right, above, below, constant_values)


def pad_box(grid: Grid, minx, miny, maxx, maxy, *, constant_values=None) -> Grid:
    """Grow by all cells whose centres lie within the bounds widened by half a cell."""
    rx, ry = map(abs, grid.meta.resolution())
    return pad_xy(grid, minx - rx / 2, miny - ry / 2, maxx + rx / 2, maxy + ry / 2, constant_values=constant_values)
