"""Warping to another grid or system.

The target grid is generated, its centres are taken back to source places by
Column arithmetic, and cells meet by an equi-join on integer places, so bands
share one index and nothing is joined on floating point.  Interpolating
methods spread each target over its stencil before the join.  Area methods
weigh a source cell by the part of it that the target covers; where rows and
columns can be told apart (between unsheared grids in one system, or in
geographic and Mercator ones) source cells go to the targets that they meet
without a join, else targets are spread over the box of their corners' places.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import crs as crs_lib
from gridloom.functions.affine import Affine
from gridloom.plans.grid import KEYS, Grid
from gridloom.plans.meta import GridMeta

INTERPOLATING = {"nearest": 1, "bilinear": 2, "cubic": 4}
#: Of the values v that a target meets, with the parts w of their cells that it covers.
GROUPING = {
    "average": lambda v, w: F.sum(w * v) / F.sum(w), "sum": lambda v, w: F.sum(w * v), "rms": lambda v, w: F.sqrt(F.sum(w * v * v) / F.sum(w)), "mode": None,
    "min": lambda v, w: F.min(v), "max": lambda v, w: F.max(v), "med": lambda v, w: F.percentile(v, 0.5), "q1": lambda v, w: F.percentile(v, 0.25), "q3": lambda v, w: F.percentile(v, 0.75),
}
_APART = {"geographic", "web_mercator", "mercator"}  # systems in which x is one of longitude and y one of latitude alone
_TOUCH = 1e-9  # less of a cell does not count


def resampling_name(name) -> str:
    """A method by name, whatever its case."""
    found = str(getattr(name, "name", name)).lower()
    if found not in INTERPOLATING and found not in GROUPING:
        raise ValueError(f"unknown resampling method {name!r}; known: {sorted({*INTERPOLATING, *GROUPING})}")
    return found


def default_grid(meta: GridMeta, dst, resolution=None, shape=None) -> tuple[Affine, int, int]:
    """(transform, width, height) of the target: square cells that keep the diagonal, over the transformed edges."""
    src, dst = meta.need_crs(), crs_lib.parse_crs(dst)
    point = _forward(meta, src, dst)
    edge = crs_lib.edge_points((0, 0, meta.width, meta.height), 21)
    xs, ys = point(edge[:, 0], edge[:, 1])
    left, right, bottom, top = float(np.min(xs)), float(np.max(xs)), float(np.min(ys)), float(np.max(ys))
    if shape is not None:
        height, width = shape
        rx, ry = (right - left) / width, (top - bottom) / height
    elif resolution is not None:
        rx, ry = map(abs, resolution if isinstance(resolution, (tuple, list)) else (resolution, resolution))
        width, height = math.ceil((right - left) / rx - 1e-6), math.ceil((top - bottom) / ry - 1e-6)
    else:
        (x0, x1), (y0, y1) = point(np.array([0.0, meta.width]), np.array([0.0, meta.height]))
        rx = ry = math.hypot(x1 - x0, y1 - y0) / math.hypot(meta.width, meta.height)
        width, height = max(1, math.floor((right - left) / rx + 0.5)), max(1, math.floor((top - bottom) / ry + 0.5))
    return Affine(rx, 0, left, 0, -ry, top), width, height


def fit_gcps(gcps) -> Affine:
    """Least-squares affine of ground control points with row, col, x, y."""
    places = np.array([[g["col"], g["row"]] for g in gcps], float)
    middle = places.mean(0)
    rows = []
    for k in ("x", "y"):  # around the means, which keeps large coordinates from costing digits
        v = np.array([g[k] for g in gcps], float)
        a, b = np.linalg.lstsq(places - middle, v - v.mean(), rcond=None)[0]
        rows += [float(a), float(b), float(v.mean() - a * middle[0] - b * middle[1])]
    return Affine(*rows)


def rpc_place(rpcs: dict, lon, lat, height=0.0):
    """(col, row) of ground points by rational polynomials."""
    number = lambda k: float(rpcs[k])
    p, q, h = (lat - number("lat_off")) / number("lat_scale"), (lon - number("long_off")) / number("long_scale"), (height - number("height_off")) / number("height_scale")
    # The standard order of the twenty terms.
    terms = [1, q, p, h, q * p, q * h, p * h, q * q, p * p, h * h, p * q * h, q * q * q, q * p * p, q * h * h, q * q * p, p * p * p, p * h * h, q * q * h, p * p * h, h * h * h]
    poly = lambda k: sum((t * float(c) for t, c in zip(terms, rpcs[k])), F.lit(0.0) if isinstance(p, Column) else 0.0)
    row = poly("line_num_coeff") / poly("line_den_coeff") * number("line_scale") + number("line_off")
    col = poly("samp_num_coeff") / poly("samp_den_coeff") * number("samp_scale") + number("samp_off")
    return col, row


def _forward(meta: GridMeta, src, dst):
    t = fit_gcps(meta.gcps) if meta.gcps else meta.transform

    def point(col, row):
        return crs_lib.transform(src, dst, *t(col, row))

    return point


def _source_place(meta: GridMeta, src, dst, x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional (col, row) in the source of target coordinates."""
    if meta.rpcs:
        col, row = rpc_place(meta.rpcs, *crs_lib.transform(dst, crs_lib.parse_crs(4326), x, y))
        return col + 0.5, row + 0.5
    t = (fit_gcps(meta.gcps) if meta.gcps else meta.transform).inverse()
    sx, sy = crs_lib.transform(dst, src, x, y)
    col, row = sx * t.a + t.c, sy * t.e + t.f
    if t.b:
        col = sx * t.a + sy * t.b + t.c
    if t.d:
        row = sx * t.d + sy * t.e + t.f
    return col, row


def target_cells(spark, transform: Affine, width: int, height: int) -> DataFrame:
    """(row, col) of a grid, generated in parallel."""
    ids = spark.range(width * height)
    return ids.select((F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"))


def _xy(t: Affine) -> tuple[Column, Column]:
    col, row = F.col("col") + 0.5, F.col("row") + 0.5
    return col * t.a + row * t.b + t.c if t.b else col * t.a + t.c, col * t.d + row * t.e + t.f if t.d else row * t.e + t.f


def _cubic(d: Column) -> Column:
    """Keys' kernel with a = -0.5."""
    d = F.abs(d)
    return F.when(d <= 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)


def reproject(grid: Grid, dst_crs, *, resolution=None, shape=None, transform: Affine | None = None, resampling="nearest", nodata=None, src_geoloc_array=None, gcps=None, rpcs=None) -> Grid:
    """The raster on a grid in another system: the given one, or the default one of ``default_grid``.

    Cells without a value stay absent; ``densify`` puts the missing value there.
    """
    if resolution is not None and (shape is not None or transform is not None):
        raise ValueError("resolution can't be given with shape or transform")
    method = resampling_name(resampling)
    m = grid.meta
    if gcps:
        m = m.with_(gcps=tuple(gcps))
    if rpcs:
        m = m.write_rpcs(rpcs)
    src, dst = m.need_crs(), crs_lib.parse_crs(dst_crs)
    if transform is not None:
        height, width = shape or m.shape
    else:
        transform, width, height = default_grid(m, dst, resolution, shape)
    meta = m.with_(width=width, height=height, transform=transform, crs=dst, x_dim="x", y_dim="y", gcps=(), rpcs=None, has_coords=True, nodata=m.target_nodata(nodata) if m.nodata is None or nodata is not None else m.nodata)
    source, value = Grid(grid.df, m).valid(), grid.value
    if src_geoloc_array is not None:
        return Grid(_by_places(source, src_geoloc_array, meta, src, dst, value), meta)
    if method in GROUPING:
        apart = m.transform.rectilinear and transform.rectilinear and not m.gcps and not m.rpcs and (src == dst or {src.kind, dst.kind} <= _APART)
        covered = (_covered_apart if apart else _covered)(source, m, meta, src, dst, value)
        return Grid(_grouped(covered, method, value), meta)
    x, y = _xy(transform)
    col, row = _source_place(m, src, dst, x, y)
    cells = target_cells(grid.df.sparkSession, transform, width, height).select("row", "col", col.alias("u"), row.alias("v"))
    cells = cells.where((F.col("u") >= 0) & (F.col("u") < m.width) & (F.col("v") >= 0) & (F.col("v") < m.height))
    taps = source.select("band", F.col("row").alias("s_row"), F.col("col").alias("s_col"), value)
    if method == "nearest":
        index = cells.select("row", "col", F.floor("v").cast("int").alias("s_row"), F.floor("u").cast("int").alias("s_col"))
        return Grid(index.join(taps, ["s_row", "s_col"]).select(*KEYS, value), meta)
    n = INTERPOLATING[method]
    steps = F.array(*[F.lit(k) for k in range(1 - n // 2, 1 + n // 2)])
    cells = cells.withColumns({"u0": F.floor(F.col("u") - 0.5).cast("int"), "v0": F.floor(F.col("v") - 0.5).cast("int")})
    cells = cells.withColumn("s_row", F.explode(F.transform(steps, lambda k: F.col("v0") + k))).withColumn("s_col", F.explode(F.transform(steps, lambda k: F.col("u0") + k)))
    kernel = (lambda d: 1 - F.abs(d)) if method == "bilinear" else _cubic
    weight = kernel(F.col("u") - 0.5 - F.col("s_col")) * kernel(F.col("v") - 0.5 - F.col("s_row"))
    cells = cells.select("row", "col", "s_row", "s_col", weight.alias("w")).where("w <> 0")
    mixed = cells.join(taps, ["s_row", "s_col"]).groupBy(*KEYS).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value), F.sum("w").alias("w"))
    return Grid(mixed.where(F.abs("w") > 1e-9).select(*KEYS, value), meta)


def _spread(cells: DataFrame, name: str, edge: Column, other: Column, size: int) -> DataFrame:
    """A row for each whole place in 0 .. size - 1 between two edges."""
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(size)))
    cells = cells.withColumns({"lo": F.floor(inside(F.least(edge, other))).cast("int"), "hi": F.ceil(inside(F.greatest(edge, other))).cast("int") - 1})
    return cells.where("lo <= hi").withColumn(name, F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def _part(place: Column, edge: Column, other: Column) -> Column:
    """How much of the place, which is 1 long, lies between two edges."""
    return F.least(place + 1, F.greatest(edge, other)) - F.greatest(place.cast("double"), F.least(edge, other))


def _covered_apart(source: DataFrame, m: GridMeta, meta: GridMeta, src, dst, value: str) -> DataFrame:
    """(band, row, col, value, w): source cells with the targets that they meet, rows by rows and columns by columns."""
    t, back, zero = m.transform, meta.transform.inverse(), F.lit(0.0)
    s_row, s_col = F.col("s_row"), F.col("s_col")
    to_row = lambda r: crs_lib.transform(src, dst, zero, r * t.e + t.f)[1] * back.e + back.f
    to_col = lambda c: crs_lib.transform(src, dst, c * t.a + t.c, zero)[0] * back.a + back.c
    from_row = lambda r: _source_place(m, src, dst, zero, r * meta.transform.e + meta.transform.f)[1]
    from_col = lambda c: _source_place(m, src, dst, c * meta.transform.a + meta.transform.c, zero)[0]
    cells = source.select("band", F.col("row").alias("s_row"), F.col("col").alias("s_col"), value)
    cells = _spread(cells, "row", to_row(s_row), to_row(s_row + 1), meta.height)
    cells = cells.withColumn("w", _part(s_row, from_row(F.col("row")), from_row(F.col("row") + 1))).where(F.col("w") > _TOUCH)
    cells = _spread(cells, "col", to_col(s_col), to_col(s_col + 1), meta.width)
    cells = cells.withColumn("part", _part(s_col, from_col(F.col("col")), from_col(F.col("col") + 1))).where(F.col("part") > _TOUCH)
    return cells.select(*KEYS, value, (F.col("w") * F.col("part")).alias("w"))


def _covered(source: DataFrame, m: GridMeta, meta: GridMeta, src, dst, value: str) -> DataFrame:
    """The same from targets, each spread over the source cells in the box of its corners' places; all bands share these."""
    t = meta.transform
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (t(F.col("col") + i, F.col("row") + j) for i in (0.0, 1.0) for j in (0.0, 1.0))])

    def place(p):
        u, v = _source_place(m, src, dst, p["x"], p["y"])
        return F.struct(u.alias("u"), v.alias("v"))

    cells = target_cells(source.sparkSession, t, meta.width, meta.height).select("row", "col", F.transform(corners, place).alias("p"))
    # Boxes come from a generator, or the places' long expressions would be repeated wherever an edge is used.
    box = F.struct(*[pick(F.col("p")[c]).alias(f"{c}{k}") for c in "uv" for k, pick in enumerate((F.array_min, F.array_max))])
    cells = cells.select("row", "col", F.inline(F.array(box)))
    cells = _spread(cells, "s_row", F.col("v0"), F.col("v1"), m.height)
    cells = _spread(cells, "s_col", F.col("u0"), F.col("u1"), m.width)
    down, across = _part(F.col("s_row"), F.col("v0"), F.col("v1")), _part(F.col("s_col"), F.col("u0"), F.col("u1"))
    index = cells.where((down > _TOUCH) & (across > _TOUCH)).select("row", "col", "s_row", "s_col", (down * across).alias("w"))
    taps = source.select("band", F.col("row").alias("s_row"), F.col("col").alias("s_col"), value)
    return index.join(taps, ["s_row", "s_col"]).select(*KEYS, value, "w")


def _grouped(covered: DataFrame, method: str, value: str) -> DataFrame:
    v, w = F.col(value), F.col("w")
    if method == "mode":  # the value that covers most; of several the least
        covered = covered.groupBy(*KEYS, value).agg(F.round(F.sum(w), 9).alias("w"))
        return covered.groupBy(*KEYS).agg(F.min_by(v, F.struct(-w, v)).alias(value))
    return covered.groupBy(*KEYS).agg(GROUPING[method](v, w).alias(value))


def _by_places(source: DataFrame, places: DataFrame, meta: GridMeta, src, dst, value: str) -> DataFrame:
    """Each source cell goes to the target that holds its place (row, col, x, y); of several the nearest to the centre wins."""
    x, y = crs_lib.transform(src, dst, F.col("x"), F.col("y"))
    t = meta.transform.inverse()
    u, v = x * t.a + y * t.b + t.c, x * t.d + y * t.e + t.f
    index = places.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), u.alias("u"), v.alias("v"))
    index = index.select("s_row", "s_col", F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col"), (F.pow(F.col("u") - F.floor("u") - 0.5, 2) + F.pow(F.col("v") - F.floor("v") - 0.5, 2)).alias("d"))
    index = index.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1))
    cells = source.select("band", F.col("row").alias("s_row"), F.col("col").alias("s_col"), value).join(index, ["s_row", "s_col"])
    return cells.groupBy(*KEYS).agg(F.min_by(value, F.struct("d", "s_row", "s_col")).alias(value))


def densify(grid: Grid, fill=None) -> Grid:
    """Every cell of every band present; absent ones hold ``fill``, else the missing value."""
    m, spark = grid.meta, grid.df.sparkSession
    fill = fill if fill is not None else m.target_nodata()
    every = target_cells(spark, m.transform, m.width, m.height).withColumn("band", F.explode(F.array(*[F.lit(b) for b in m.bands])))
    value = F.coalesce(F.col(grid.value), F.lit(fill).cast(dict(grid.df.dtypes)[grid.value]))
    return Grid(every.join(grid.df, list(KEYS), "left").select(*KEYS, value.alias(grid.value)), m)


def reproject_match(grid: Grid, match: Grid | GridMeta, *, resampling="nearest", **more) -> Grid:
    """The raster on the grid and system of another one."""
    other = match.meta if isinstance(match, Grid) else match
    out = reproject(grid, other.need_crs(), transform=other.transform, shape=other.shape, resampling=resampling, **more)
    return out.with_(x_dim=other.x_dim, y_dim=other.y_dim)
