"""Filling missing cells from valid ones of the same band, in coordinate space.

nearest: a distance transform in two steps, whatever the raster's size.  Along
rows, each valid cell owns the columns that it is nearest to; along columns,
each cell takes the least of the rows' candidates.  No step compares all cells
with all, and a task holds one row's valid cells or a block of columns.
linear and cubic: a Delaunay triangulation of each band's valid cells,
interpolated inside its hull.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import RasterError
from gridloom.functions.triangles import interpolate
from gridloom.plans.grid import KEYS, Grid

#: Cells of a block of columns in nearest filling: what a task holds, or one column if that is more.
COLUMN_CELLS = 1 << 19


def least_by_column(cost: np.ndarray, rows: np.ndarray, height: int, step: float) -> np.ndarray:
    """For each cell (row i, column j) the place k of the least cost[k, j] + ((rows[k] - i) * step)**2, the first where several are least.

    Such places never go back as i grows, so the middle row's parts the work in two, for all columns at a time.
    """
    width = cost.shape[1]
    out = np.empty((height, width), np.int64)
    column = np.arange(width)
    start, stop = np.zeros(width, np.int64), np.full(width, height)
    low, high = np.zeros(width, np.int64), np.full(width, len(rows) - 1)
    while len(start):
        middle, size = (start + stop) // 2, high - low + 1
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        k = np.arange(size.sum()) + np.repeat(low - begin, size)
        d = cost[k, column[of]] + ((rows[k] - middle[of]) * step) ** 2
        least = np.flatnonzero(d == np.minimum.reduceat(d, begin)[of])
        best = k[least[np.searchsorted(least, begin)]]
        out[middle, column] = best
        above, below = start < middle, middle + 1 < stop
        column = np.r_[column[above], column[below]]
        start, stop, low, high = np.r_[start[above], middle[below] + 1], np.r_[middle[above], stop[below]], np.r_[low[above], best[below]], np.r_[best[above], high[below]]
    return out


def _nearest(grid: Grid) -> DataFrame:
    m, value, kinds = grid.meta, grid.value, dict(grid.df.dtypes)
    rx, ry = map(abs, m.resolution())
    height, width = m.height, m.width
    block = max(1, COLUMN_CELLS // max(height, 1))
    in_row = Window.partitionBy("band", "row").orderBy("col")
    before, after = F.lag("col").over(in_row), F.lead("col").over(in_row)
    # The columns that a valid cell is nearest to in its row; of two at one distance the left one.
    owned = grid.valid().select("band", "row", "col", value, F.coalesce(F.floor((before + F.col("col")) / 2) + 1, F.lit(0)).cast("int").alias("low"), F.coalesce(F.floor((F.col("col") + after) / 2), F.lit(width - 1)).cast("int").alias("high"))
    dealt = owned.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left = int(pdf["block"].iloc[0]) * block
        across = min(block, width - left)
        pdf = pdf.sort_values(["row", "col"])
        rows, at = np.unique(pdf["row"].to_numpy(), return_inverse=True)
        low, high = np.maximum(pdf["low"].to_numpy(), left), np.minimum(pdf["high"].to_numpy(), left + across - 1)
        owner = np.repeat(np.arange(len(pdf)), high - low + 1).reshape(len(rows), across)  # every row's columns are owned, once each
        from_col = pdf["col"].to_numpy()[owner]
        aside = from_col - (left + np.arange(across))
        k = least_by_column((aside * rx) ** 2, rows, height, ry)
        known = np.zeros((height, across), bool)
        known[rows] = aside == 0
        row, col = np.nonzero(~known)
        return pd.DataFrame({"band": pdf["band"].iloc[0], "row": row, "col": col + left, value: pdf[value].to_numpy()[owner[k[row, col], col]]})

    return dealt.groupBy("band", "block").applyInPandas(fill, f"band {kinds['band']}, row int, col int, {value} {kinds[value]}")


def interpolate_na(grid: Grid, method: str = "nearest") -> Grid:
    """Fill missing cells; outside the hull of valid cells linear and cubic leave the missing value.

    A raster without any valid cell stays as it is.
    """
    m, value = grid.meta, grid.value
    if m.found_nodata() is None:
        raise RasterError("the missing value must be known to fill missing cells")
    if method == "nearest":
        new = _nearest(grid)
    elif method in ("linear", "cubic"):
        kinds = dict(grid.df.dtypes)
        t, width, height = m.transform, m.width, m.height

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            known = np.zeros((height, width), bool)
            known[pdf["row"], pdf["col"]] = True
            rows, cols = np.nonzero(~known)
            center = lambda c, r: np.stack(t.center(np.asarray(c, float), np.asarray(r, float)), 1)
            got = interpolate(center(pdf["col"], pdf["row"]), pdf[value].to_numpy(float), center(cols, rows), method)
            out = pd.DataFrame({"band": pdf["band"].iloc[0], "row": rows, "col": cols, value: got})
            return out[np.isfinite(got)]

        # One band's raster at a time: a triangulation needs its points together.
        new = grid.valid().groupBy("band").applyInPandas(fill, f"band {kinds['band']}, row int, col int, {value} double")
    else:
        raise ValueError(f"unknown method {method!r}; known: nearest, linear, cubic")
    new = new.select(*[F.col(k).cast(dict(grid.df.dtypes)[k]).alias(k) for k in (*KEYS, value)])
    old = grid.valid().select(*KEYS, value)
    rest = grid.df.select(*KEYS, value).join(old, list(KEYS), "left_anti").join(new, list(KEYS), "left_anti")
    return grid.with_(old.unionByName(new).unionByName(rest))
