"""Mosaics: inputs on one grid, one aggregate picks or combines where they overlap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import crs as crs_lib
from gridloom.functions.affine import Affine, Bounds
from gridloom.operators.algebra import place_key, places_of
from gridloom.operators.warp import reproject
from gridloom.plans.grid import Grid, GridSet

PICKS = {
    "first": lambda v: F.min_by(v, "priority"),
    "last": lambda v: F.max_by(v, "priority"),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "sum": lambda v: F.sum(v),
    "count": lambda v: F.count(v).cast("long"),
}


def mosaic_grid(metas, bounds=None, res=None) -> tuple[Affine, int, int]:
    """(transform, width, height): the union of the bounds from its top left, whole cells up."""
    rx, ry = map(abs, metas[0].resolution()) if res is None else map(abs, res if isinstance(res, (tuple, list)) else (res, res))
    if bounds is None:
        all_bounds = [m.bounds() for m in metas]
        bounds = (min(b.left for b in all_bounds), min(b.bottom for b in all_bounds), max(b.right for b in all_bounds), max(b.top for b in all_bounds))
    b = Bounds(*bounds)
    return Affine(rx, 0, b.left, 0, -ry, b.top), math.ceil((b.right - b.left) / rx - 1e-6), math.ceil((b.top - b.bottom) / ry - 1e-6)


def merge_arrays(grids: list[Grid], *, bounds=None, res=None, nodata=None, precision=None, method="first", crs=None, parse_coordinates=True) -> Grid:
    """One raster of several.  Inputs whose system or cell size differs are warped first (nearest).

    ``method``: first, last, min, max, sum, count, or a function from a Column
    with an array of a cell's values, in the order of the inputs, to a Column.
    ``precision`` rounds bounds to so many digits.
    """
    target = crs_lib.parse_crs(crs) if crs is not None else grids[0].meta.crs
    rx, ry = map(abs, grids[0].meta.resolution()) if res is None else map(abs, res if isinstance(res, (tuple, list)) else (res, res))
    same = lambda m: m.crs == target and all(math.isclose(abs(a), b, rel_tol=1e-9) for a, b in zip(m.resolution(), (rx, ry)))
    ready = [g if same(g.meta) else reproject(g, target, resolution=(rx, ry)) for g in grids]
    if precision is not None and bounds is None:
        every = [m.meta.bounds() for m in ready]
        bounds = tuple(round(f(b[k] for b in every), precision) for k, f in enumerate((min, min, max, max)))
    transform, width, height = mosaic_grid([g.meta for g in ready], bounds, (rx, ry))
    parts, out = [], ready[0].meta.with_(width=width, height=height)
    for k, g in enumerate(ready):
        t = g.meta.transform
        # Nearest place of a cell's centre: a whole shift, and a mirror where an axis runs the other way.
        place = lambda name, step, start, out_step, out_start: F.floor((F.col(name) + 0.5) * (step / out_step) + ((start - out_start) / out_step + 1e-9)).cast("int")
        moved = g.valid().select("band", place("row", t.e, t.f, transform.e, transform.f).alias("row"), place("col", t.a, t.c, transform.a, transform.c).alias("col"), F.col(g.value).alias("value"), F.lit(k).alias("priority"))
        inside = moved.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
        parts.append(inside.select(place_key(out).alias("key"), "value", "priority"))
    cells = reduce(DataFrame.unionByName, parts).groupBy("key")
    if callable(method):
        ordered = cells.agg(F.sort_array(F.collect_list(F.struct("priority", "value"))).alias("all"))
        df = ordered.select(*places_of(out), method(F.transform("all", lambda s: s["value"])).alias("value"))
    elif method in PICKS:
        df = cells.agg(PICKS[method](F.col("value")).alias("value")).select(*places_of(out), "value")
    else:
        raise ValueError(f"unknown merge method {method!r}; known: {sorted(PICKS)} or a function")
    first = ready[0].meta
    missing = nodata if nodata is not None else first.found_nodata()
    meta = first.with_(width=width, height=height, transform=transform, crs=target, nodata=missing, has_coords=parse_coordinates, bands=tuple(sorted({b for g in ready for b in g.meta.bands})))
    return Grid(df.withColumnRenamed("value", grids[0].value), meta)


def merge_datasets(sets: list[GridSet], **options) -> GridSet:
    """One set of several: each variable of the first is merged from all."""
    names = list(sets[0].grids)
    return GridSet({k: merge_arrays([s.grids[k] for s in sets], **options) for k in names}, sets[0].others)
