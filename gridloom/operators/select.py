"""Selection: windows, boxes, labels and positions.  All become filters on integer row, col and band."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.errors import NoCellsInBounds, OneCellWide
from gridloom.functions import crs as crs_lib
from gridloom.functions.affine import Bounds, Window, snap
from gridloom.plans.grid import Grid


def cut(grid: Grid, w: Window) -> Grid:
    """The cells of a whole-cell window, counted from its corner."""
    row, col = F.col("row"), F.col("col")
    df = grid.df.where((row >= w.row_start) & (row < w.row_stop) & (col >= w.col_start) & (col < w.col_stop))
    shifted = df.withColumns({k: (F.col(k) - F.lit(int(s))).cast("int") for k, s in (("row", w.row_start), ("col", w.col_start)) if s})
    return Grid(shifted, grid.meta.cut(w))


def isel_window(grid: Grid, window: Window, pad: bool = False) -> Grid:
    """Cells of a row/col window; starts round down, stops up.  ``pad`` fills what lies outside."""
    inside = snap(window, grid.meta.width, grid.meta.height)
    out = cut(grid, inside)
    if pad:
        from gridloom.operators.pad import frame

        full = Window(*(math.floor(v) if k % 2 == 0 else math.ceil(v) for k, v in enumerate(window)))
        left, above = int(inside.col_start - full.col_start), int(inside.row_start - full.row_start)
        out = frame(out, left, int(full.col_stop - full.col_start) - left - out.meta.width, above, int(full.row_stop - full.row_start) - above - out.meta.height)
    return out


def _label_range(start: float, step: float, n: int, low: float, high: float) -> tuple[int, int]:
    """First and last+1 place whose centre start + (k + .5) * step lies within low..high."""
    ends = sorted(((low - start) / step - 0.5, (high - start) / step - 0.5))
    first, last = max(math.ceil(ends[0]), 0), min(math.floor(ends[1]), n - 1)
    # Floating point may put a centre that equals a bound on either side of it.
    while first > 0 and low <= start + (first - 0.5) * step <= high:
        first -= 1
    while last < n - 1 and low <= start + (last + 1.5) * step <= high:
        last += 1
    while first <= last and not low <= start + (first + 0.5) * step <= high:
        first += 1
    while last >= first and not low <= start + (last + 0.5) * step <= high:
        last -= 1
    return first, max(last + 1, first)


def slice_xy(grid: Grid, minx: float, miny: float, maxx: float, maxy: float) -> Grid:
    """Cells whose centres lie within the bounds, ends included, whichever way the axes run."""
    t = grid.meta.transform
    c0, c1 = _label_range(t.c, t.a, grid.meta.width, minx, maxx)
    r0, r1 = _label_range(t.f, t.e, grid.meta.height, miny, maxy)
    return cut(grid, Window(r0, r1, c0, c1))


def clip_box(grid: Grid, minx, miny, maxx, maxy, *, auto_expand=False, auto_expand_limit=3, crs=None, allow_one_dimensional_raster=False) -> Grid:
    """The cells that bounds touch.  ``auto_expand`` widens bounds that leave less than two rows or columns by half a
    cell a side, fewer than ``auto_expand_limit`` times."""
    box = Bounds(minx, miny, maxx, maxy)
    if crs is not None and (src := crs_lib.parse_crs(crs)) != grid.meta.need_crs():
        box = crs_lib.transform_bounds(src, grid.meta.crs, box)
        if src.geographic is False and grid.meta.crs.geographic and box.right - box.left > 180:
            raise NoCellsInBounds("the transformed bounds cross the antimeridian; give them in two parts")
    rx, ry = map(abs, grid.meta.resolution())
    tries = 1 if auto_expand else auto_expand_limit
    while True:
        w = snap(grid.meta.recalculated_transform().window(box), grid.meta.width, grid.meta.height)
        h, n = w.row_stop - w.row_start, w.col_stop - w.col_start
        if h > 1 and n > 1 or h >= 1 and n >= 1 and allow_one_dimensional_raster:
            return cut(grid, w)
        if tries >= auto_expand_limit:
            if h < 1 or n < 1:
                raise NoCellsInBounds("no cell lies in these bounds; auto_expand widens them")
            raise OneCellWide("the bounds leave a single row or column; auto_expand widens them")
        box = Bounds(box.left - rx / 2, box.bottom - ry / 2, box.right + rx / 2, box.top + ry / 2)
        tries += 1
        allow_one_dimensional_raster = False


def isel(grid: Grid, *, band=None, row=None, col=None) -> Grid:
    """By position: an int drops to that place, a slice may have a step of either sign, a list picks in its order and with repeats."""
    meta, df = grid.meta, grid.df
    for name, key, n in (("band", band, meta.count), ("row", row, meta.height), ("col", col, meta.width)):
        if key is None:
            continue
        places = [key % n] if isinstance(key, int) else list(range(n))[key] if isinstance(key, slice) else [k % n for k in key]
        labels = [meta.bands[k] for k in places] if name == "band" else places
        if name == "band":
            df = df.where(F.col("band").isin(labels))
            meta = meta.with_(bands=tuple(labels))
            continue
        start = places[0] if places else 0
        step = places[1] - places[0] if len(places) > 1 else 1
        if step and places == list(range(start, start + step * len(places), step)):
            c = F.col(name)
            inside = c.between(min(places), max(places)) if places else F.lit(False)
            df = df.where(inside & (F.pmod(c - start, F.lit(abs(step))) == 0)).withColumn(name, ((c - start) / step).cast("int"))
        else:  # any order and repeats: each cell goes to all its places
            cases = [F.when(F.col(name) == k, F.array(*[F.lit(i) for i, p in enumerate(places) if p == k])) for k in dict.fromkeys(places)]
            df = df.where(F.col(name).isin(list(set(places)))).withColumn("_to", F.explode(F.coalesce(*cases))).withColumn(name, F.col("_to").cast("int")).drop("_to")
        t = meta.transform
        if name == "row":
            t = t._replace(b=t.b * step, e=t.e * step) if step != 1 else t
            t = t._replace(c=meta.transform.center(0, start)[0] - 0.5 * t.a - 0.5 * t.b, f=meta.transform.center(0, start)[1] - 0.5 * t.d - 0.5 * t.e)
            meta = meta.with_(height=len(places), transform=t)
        else:
            t = t._replace(a=t.a * step, d=t.d * step) if step != 1 else t
            t = t._replace(c=meta.transform.center(start, 0)[0] - 0.5 * t.a - 0.5 * t.b, f=meta.transform.center(start, 0)[1] - 0.5 * t.d - 0.5 * t.e)
            meta = meta.with_(width=len(places), transform=t)
    return Grid(df, meta)


def sel_nearest(grid: Grid, x: float, y: float) -> Grid:
    """The cell whose centre is nearest to a point; of two at the same distance that with the smaller place."""
    t, m = grid.meta.transform, grid.meta
    col = min(max(math.ceil((x - t.c) / t.a - 1), 0), m.width - 1)
    row = min(max(math.ceil((y - t.f) / t.e - 1), 0), m.height - 1)
    return cut(grid, Window(row, row + 1, col, col + 1))
