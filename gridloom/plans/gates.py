"""Registered raster queries and their SQL.

The SQL works from coordinates and closed forms of its own, not from the
places that the operators compute.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom.functions import cells as cell
from gridloom.functions import crs as crs_lib
from gridloom.functions.affine import Affine, Window
from gridloom.plans import rasters
from gridloom.plans.grid import Grid, GridSet

QUERIES: dict = {}
ORACLES: dict = {}

R1 = """r1 AS (SELECT band, (i // 8)::INT AS row, (i % 8)::INT AS col, v::DOUBLE AS value, 10 + ((i % 8) + 0.5) * 0.5::DOUBLE AS x, 50 - ((i // 8) + 0.5) * 0.25::DOUBLE AS y
  FROM (SELECT vec_id::INT AS band, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"""
R2 = """r2 AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS band, round(l_discount * 100)::INT AS row, (l_quantity - 1)::INT AS col, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS value
  FROM lineitem GROUP BY 1, 2, 3)"""
R3 = """r3 AS (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS band, (user_id % 64)::INT AS row,
  floor(epoch(ts - TIMESTAMP '2024-01-01') / 21600)::INT AS col, max(value) AS value FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1, 2, 3)"""
R4 = "r4 AS (SELECT 1 AS band, substr(p_brand, 7)::INT - 1 AS row, (p_size - 1)::INT AS col, max(round(p_retailprice * 100)::BIGINT) AS value FROM part GROUP BY 1, 2, 3)"


def gate(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _rounded(grid: Grid, digits: int = 6):
    v = grid.value
    return grid.df.select("band", "row", "col", F.round(F.col(v).cast("double"), digits).alias("value"))


# ---- scans and geometry


@gate(f"WITH {R1} SELECT band, row, col, value FROM r1")
def cells(spark, sf_dir):
    return rasters.tiles(spark, sf_dir).df


@gate(f"WITH {R2} SELECT DISTINCT row, col, 500015.0::DOUBLE + 30 * col AS x, 4599985.0::DOUBLE - 30 * row AS y FROM r2")
def coords(spark, sf_dir):
    return rasters.sales(spark, sf_dir).with_coords().select("row", "col", "x", "y").distinct()


@gate(f"WITH {R1} SELECT count(DISTINCT x) AS width, count(DISTINCT y) AS height, count(DISTINCT band) AS bands, min(x) - 0.25 AS minx, min(y) - 0.125 AS miny, max(x) + 0.25 AS maxx, max(y) + 0.125 AS maxy FROM r1")
def dims_bounds(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    rx, ry = map(abs, g.meta.resolution())
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("long")
    return g.with_coords().agg(
        size("col").alias("width"), size("row").alias("height"), F.count_distinct("band").alias("bands"),
        (F.min("x") - rx / 2).alias("minx"), (F.min("y") - ry / 2).alias("miny"), (F.max("x") + rx / 2).alias("maxx"), (F.max("y") + ry / 2).alias("maxy"),
    )


@gate(f"WITH {R1}, b AS (SELECT min(x) - 0.25 AS l, max(x) + 0.25 AS r, min(y) - 0.125 AS b, max(y) + 0.125 AS t FROM r1) SELECT round(6378137 * radians(l), 4) AS minx, round(6378137 * atanh(sin(radians(b))), 4) AS miny, round(6378137 * radians(r), 4) AS maxx, round(6378137 * atanh(sin(radians(t))), 4) AS maxy FROM b")
def transform_bounds(spark, sf_dir):
    """Densified edges of the scanned raster's bounds, transformed and reduced in the plan."""
    g = rasters.tiles(spark, sf_dir)
    rx, ry = map(abs, g.meta.resolution())
    b = g.with_coords().agg((F.min("x") - rx / 2).alias("l"), (F.min("y") - ry / 2).alias("b"), (F.max("x") + rx / 2).alias("r"), (F.max("y") + ry / 2).alias("t"))
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(22)), lambda k: k / 22.0))
    p = b.withColumn("t0", t)
    along_x, along_y = F.col("l") + (F.col("r") - F.col("l")) * F.col("t0"), F.col("b") + (F.col("t") - F.col("b")) * F.col("t0")
    points = p.select(F.inline(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((along_x, F.col("b")), (along_x, F.col("t")), (F.col("l"), along_y), (F.col("r"), along_y))])))
    x, y = crs_lib.transform(g.meta.crs, 3857, F.col("x"), F.col("y"))
    return points.select(x.alias("x"), y.alias("y")).agg(F.round(F.min("x"), 4).alias("minx"), F.round(F.min("y"), 4).alias("miny"), F.round(F.max("x"), 4).alias("maxx"), F.round(F.max("y"), 4).alias("maxy"))


@gate(f"WITH {R1} SELECT DISTINCT row, col, (32600 + floor((x + 180) / 6)::INT + 1)::INT AS epsg FROM r1")
def utm_zone(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    zone = F.floor((F.col("x") + 180) / 6).cast("int") + 1
    return g.with_coords().select("row", "col", F.when(F.col("y") >= 0, 32600 + zone).otherwise(32700 + zone).cast("int").alias("epsg")).distinct()


@gate(f"WITH {R1} SELECT DISTINCT row, col, round(6378137 * radians(x), 4) AS mx, round(6378137 * atanh(sin(radians(y))), 4) AS my FROM r1")
def to_mercator(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    x, y = crs_lib.transform(g.meta.crs, 3857, F.col("x"), F.col("y"))
    return g.with_coords().select("row", "col", F.round(x, 4).alias("mx"), F.round(y, 4).alias("my")).distinct()


@gate(f"WITH {R2} SELECT DISTINCT row, col, 500015.0::DOUBLE + 30 * col AS x, 4599985.0::DOUBLE - 30 * row AS y, 0.0::DOUBLE AS error_x, 0.0::DOUBLE AS error_y FROM r2")
def utm_round_trip(spark, sf_dir):
    """UTM to degrees and back in the plan: no error at a tenth of a millimetre."""
    g = rasters.sales(spark, sf_dir)
    x, y = crs_lib.from_lonlat(g.meta.crs, *crs_lib.to_lonlat(g.meta.crs, F.col("x"), F.col("y")))
    off = lambda a, b: F.abs(F.round(a - F.col(b), 4))
    return g.with_coords().select("row", "col", "x", "y", off(x, "x").alias("error_x"), off(y, "y").alias("error_y")).distinct()


# ---- selection


@gate(f"WITH {R1} SELECT band, row - 2 AS row, col - 1 AS col, value FROM r1 WHERE row >= 2 AND row < 6 AND col >= 1 AND col < 7")
def isel_window(spark, sf_dir):
    return op.isel_window(rasters.tiles(spark, sf_dir), Window(2.4, 5.2, 1.5, 6.3)).df


@gate(f"WITH {R1}, s AS (SELECT * FROM r1 WHERE x BETWEEN 10.8 AND 13.1 AND y BETWEEN 48.4 AND 49.5) SELECT band, (row - min(row) OVER ())::INT AS row, (col - min(col) OVER ())::INT AS col, value FROM s")
def slice_xy(spark, sf_dir):
    return op.slice_xy(rasters.tiles(spark, sf_dir), 10.8, 48.4, 13.1, 49.5).df


_BOX = "x + 0.25 > 11 AND x - 0.25 < 13 AND y + 0.125 > 48.6 AND y - 0.125 < 49.6"


@gate(f"WITH {R1}, s AS (SELECT * FROM r1 WHERE {_BOX}) SELECT band, (row - min(row) OVER ())::INT AS row, (col - min(col) OVER ())::INT AS col, value FROM s")
def clip_box(spark, sf_dir):
    return op.clip_box(rasters.tiles(spark, sf_dir), 11, 48.6, 13, 49.6).df


@gate(f"WITH {R1}, s AS (SELECT * FROM r1 WHERE {_BOX}) SELECT band, round(avg(value), 9) AS mean, min(value) AS min, max(value) AS max, count(*) AS count FROM s GROUP BY band")
def zonal_clip(spark, sf_dir):
    """The flagship: scan, box, statistics of each band."""
    return op.band_stats(op.clip_box(rasters.tiles(spark, sf_dir), 11, 48.6, 13, 49.6)).select("band", F.round("mean", 9).alias("mean"), "min", "max", "count")


@gate(f"WITH {R1}, s AS (SELECT * FROM r1 WHERE x + 0.25 > 11.05 - 0.25 AND x - 0.25 < 11.1 + 0.25 AND y + 0.125 > 49.01 - 0.125 AND y - 0.125 < 49.02 + 0.125) SELECT band, (row - min(row) OVER ())::INT AS row, (col - min(col) OVER ())::INT AS col, value FROM s")
def clip_box_expand(spark, sf_dir):
    return op.clip_box(rasters.tiles(spark, sf_dir), 11.05, 49.01, 11.1, 49.02, auto_expand=True).df


@gate(f"WITH {R1}, b AS (SELECT 1224514.4::DOUBLE AS l, 1447153.4::DOUBLE AS r, degrees(asin(tanh(6190000 / 6378137.0))) AS b, degrees(asin(tanh(6350000 / 6378137.0))) AS t), s AS (SELECT r1.* FROM r1, b WHERE x + 0.25 > degrees(b.l / 6378137) AND x - 0.25 < degrees(b.r / 6378137) AND y + 0.125 > b.b AND y - 0.125 < b.t) SELECT band, (row - min(row) OVER ())::INT AS row, (col - min(col) OVER ())::INT AS col, value FROM s")
def clip_box_crs(spark, sf_dir):
    return op.clip_box(rasters.tiles(spark, sf_dir), 1224514.4, 6190000, 1447153.4, 6350000, crs=3857).df


@gate(f"WITH {R1} SELECT band, (row // 2)::INT AS row, ((7 - col) // 3)::INT AS col, value FROM r1 WHERE row % 2 = 0 AND (7 - col) % 3 = 0")
def isel_strided(spark, sf_dir):
    return op.isel(rasters.tiles(spark, sf_dir), row=slice(None, None, 2), col=slice(None, None, -3)).df


@gate(f"WITH {R1}, i AS (SELECT unnest([5, 0, 5]) AS src, unnest([0, 1, 2])::INT AS dst), j AS (SELECT unnest([7, 3]) AS src, unnest([0, 1])::INT AS dst) SELECT band, i.dst AS row, j.dst AS col, value FROM r1 JOIN i ON row = i.src JOIN j ON col = j.src")
def isel_outer(spark, sf_dir):
    return op.isel(rasters.tiles(spark, sf_dir), row=[5, 0, 5], col=[7, 3]).df


@gate(f"WITH {R1} SELECT band, value FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY abs(x - 12.3) + 0, abs(y - 48.8), row, col) AS k FROM r1) WHERE k = 1")
def sel_nearest(spark, sf_dir):
    return op.sel_nearest(rasters.tiles(spark, sf_dir), 12.3, 48.8).df.select("band", "value")


# ---- missing values and encodings


@gate(f"WITH {R4} SELECT band, row, col, CASE WHEN value % 7 = 0 THEN NULL ELSE value::DOUBLE END AS value FROM r4")
def mask(spark, sf_dir):
    g = rasters.parts(spark, sf_dir)
    return g.df.select("band", "row", "col", cell.mask(F.when(F.col("value") % 7 == 0, 0).otherwise(F.col("value")), 0).alias("value"))


@gate(f"WITH {R4}, a AS (SELECT 1 AS band, i::INT AS row, j::INT AS col FROM range(25) r(i), range(50) c(j)) SELECT a.band, a.row, a.col, coalesce(value, 0)::BIGINT AS value FROM a LEFT JOIN r4 USING (row, col)")
def fill(spark, sf_dir):
    from gridloom.operators.warp import densify

    return densify(rasters.parts(spark, sf_dir)).df


@gate(f"WITH {R2} SELECT band, row, col, CASE WHEN value % 11 = 0 THEN NULL ELSE round(value * 0.01::DOUBLE + 220, 6) END AS value FROM r2")
def scale_offset(spark, sf_dir):
    g = rasters.sales(spark, sf_dir)
    stored = F.when(F.col("value") % 11 == 0, -9999).otherwise(F.col("value"))
    return g.df.select("band", "row", "col", F.round(cell.decode(stored, 0.01, 220, -9999), 6).alias("value"))


@gate(f"WITH {R2} SELECT band, row, col, round(value * CASE band WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 2 END::DOUBLE + CASE band WHEN 1 THEN 1 WHEN 2 THEN -3 ELSE 0 END, 6) AS value FROM r2")
def scale_by_band(spark, sf_dir):
    g = rasters.sales(spark, sf_dir)
    return g.df.select("band", "row", "col", F.round(cell.decode_by_band(F.col("value"), F.col("band"), (0.5, 0.25, 2), (1, -3, 0)), 6).alias("value"))


@gate(f"WITH {R4} SELECT band, row, col, (value % 65536)::INT AS value FROM r4")
def unsigned(spark, sf_dir):
    """Stored as signed 16 bits, read as unsigned."""
    g = rasters.parts(spark, sf_dir)
    stored = cell.as_signed((F.col("value") % 65536).cast("int"), "int16")
    return g.df.select("band", "row", "col", cell.as_unsigned(stored, "int16").alias("value"))


@gate(f"WITH {R2} SELECT band, row, col, CASE WHEN value % 13 = 0 THEN -32768 ELSE round((value / 100000.0::DOUBLE - 5) / 0.25) END::SMALLINT AS value FROM r2")
def encode(spark, sf_dir):
    g = rasters.sales(spark, sf_dir)
    v = F.when(F.col("value") % 13 != 0, F.col("value") / 100000.0)
    return g.df.select("band", "row", "col", cell.encode(v, 0.25, 5, -32768, "int16").alias("value"))


# ---- extension and reshaping


def _padded(left, right, above, below):
    return f"""WITH {R4}, a AS (SELECT 1 AS band, i::INT AS row, j::INT AS col FROM range({25 + above + below}) r(i), range({50 + left + right}) c(j)),
  m AS (SELECT row + {above} AS row, col + {left} AS col, value FROM r4)
  SELECT a.band, a.row, a.col, CASE WHEN a.row BETWEEN {above} AND {above + 24} AND a.col BETWEEN {left} AND {left + 49} THEN m.value ELSE 0 END::BIGINT AS value FROM a LEFT JOIN m USING (row, col)
  WHERE m.value IS NOT NULL OR NOT (a.row BETWEEN {above} AND {above + 24} AND a.col BETWEEN {left} AND {left + 49})"""


@gate(_padded(2, 3, 1, 2))
def pad_xy(spark, sf_dir):
    return op.pad_xy(rasters.parts(spark, sf_dir), -5.17, 47.33, 0.27, 50.09).df


@gate(_padded(2, 3, 1, 2))
def pad_box(spark, sf_dir):
    return op.pad_box(rasters.parts(spark, sf_dir), -5.12, 47.38, 0.22, 50.04).df


@gate(f"""WITH {R4}, a AS (SELECT 1 AS band, i::INT AS row, j::INT AS col FROM range(12) r(i), range(14) c(j)), m AS (SELECT row + 4 AS row, col + 6 AS col, value FROM r4 WHERE row < 8 AND col < 8)
  SELECT a.band, a.row, a.col, CASE WHEN a.row >= 4 AND a.col >= 6 THEN m.value ELSE 0 END::BIGINT AS value FROM a LEFT JOIN m USING (row, col) WHERE m.value IS NOT NULL OR a.row < 4 OR a.col < 6""")
def isel_pad(spark, sf_dir):
    return op.isel_window(rasters.parts(spark, sf_dir), Window(-4, 8, -6, 8), pad=True).df


@gate(f"WITH {R2} SELECT row, col, max(CASE WHEN band = 1 THEN value END) AS band_1, max(CASE WHEN band = 2 THEN value END) AS band_2, max(CASE WHEN band = 3 THEN value END) AS band_3 FROM r2 GROUP BY row, col")
def bands_as_columns(spark, sf_dir):
    return op.bands_as_columns(rasters.sales(spark, sf_dir))


@gate(f"WITH {R2} SELECT band, row, col, value::DOUBLE AS value FROM r2")
def stack_bands(spark, sf_dir):
    return op.stack_columns(op.bands_as_columns(rasters.sales(spark, sf_dir)), ["band_1", "band_2", "band_3"])


@gate(f"WITH {R2} SELECT band, row, col, value FROM r2 WHERE band = 2")
def single_band(spark, sf_dir):
    return op.isel(rasters.sales(spark, sf_dir), band=1).df


@gate("SELECT n_name AS uri, n_name IN ('FRANCE', 'GERMANY') AS kept FROM nation")
def variable_filter(spark, sf_dir):
    from gridloom.sources.tags import variable_pattern

    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name")
    uri = F.concat(F.lit('HDF5:"file.nc"://grid/'), F.col("n_name"))
    return names.select(F.col("n_name").alias("uri"), uri.rlike(variable_pattern(["grid"], ["FRANCE", "GERMANY"])).alias("kept"))


@gate(f"WITH {R1} SELECT band, (row // 2)::INT AS row, (col // 2)::INT AS col, round(avg(value), 9) AS value FROM r1 GROUP BY 1, 2, 3")
def overview(spark, sf_dir):
    """A pyramid level: cells of twice the size."""
    from gridloom.sources.tables import overview as level

    return _rounded(level(rasters.tiles(spark, sf_dir), 0), 9)


# ---- clipping by polygons: a triangle with a corner inside the grid

_TRI = [(500100.0, 4599990.0), (501300.0, 4599860.0), (500500.0, 4599670.0), (500100.0, 4599990.0)]
_GEOM = {"type": "Polygon", "coordinates": [_TRI]}


def _side(p, q, x="x", y="y"):
    return f"(({q[0]} - {p[0]})::DOUBLE * ({y} - {p[1]}) - ({q[1]} - {p[1]})::DOUBLE * ({x} - {p[0]}))"


_IN = " AND ".join(f"{_side(p, q)} < 0" for p, q in zip(_TRI, _TRI[1:]))
_R2XY = f"{R2}, g AS (SELECT *, 500015.0::DOUBLE + 30 * col AS x, 4599985.0::DOUBLE - 30 * row AS y FROM r2)"


@gate(f"WITH {_R2XY}, k AS (SELECT * FROM g WHERE {_IN}), w AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM k) SELECT g.band, g.row - w.r0 AS row, g.col - w.c0 AS col, CASE WHEN {_IN} THEN value END AS value FROM g, w WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
def clip_polygon(spark, sf_dir):
    return op.clip(rasters.sales(spark, sf_dir), [_GEOM]).df


@gate(f"WITH {_R2XY} SELECT band, row, col, CASE WHEN NOT ({_IN}) THEN value END AS value FROM g")
def clip_polygon_invert(spark, sf_dir):
    return op.clip(rasters.sales(spark, sf_dir), [_GEOM], invert=True, drop=False).df


@gate(f"WITH {_R2XY} SELECT band, row, col, CASE WHEN {_IN} THEN value END AS value FROM g")
def clip_polygon_nodrop(spark, sf_dir):
    return op.clip(rasters.sales(spark, sf_dir), [_GEOM], drop=False).df


def _meets():
    """A cell and a triangle overlap unless a side of either parts them."""
    corners = [(f"(x + {a})", f"(y + {b})") for a in (-15, 15) for b in (-15, 15)]
    apart = [" AND ".join(f"{_side(p, q, *c)} >= 0" for c in corners) for p, q in zip(_TRI, _TRI[1:])]
    xs, ys = [p[0] for p in _TRI], [p[1] for p in _TRI]
    apart += [f"x + 15 <= {min(xs)}", f"x - 15 >= {max(xs)}", f"y + 15 <= {min(ys)}", f"y - 15 >= {max(ys)}"]
    return " AND ".join(f"NOT ({a})" for a in apart)


@gate(f"WITH {_R2XY} SELECT band, row, col, CASE WHEN {_meets()} THEN value END AS value FROM g")
def clip_polygon_all_touched(spark, sf_dir):
    return op.clip(rasters.sales(spark, sf_dir), [_GEOM], all_touched=True, drop=False).df


@gate(f"""WITH {R3}, g AS (SELECT *, 500.0 + 1000 * col AS x, 63500.0 - 1000 * row AS y FROM r3)
  SELECT band, row, col, CASE WHEN pow(x - 60000, 2) + pow(y - 30000, 2) < 0 THEN value WHEN abs(x - 60000) < 30250 AND abs(y - 30000) < 20250 AND NOT (abs(x - 60000) < 10250 AND abs(y - 30000) < 5250) THEN value END AS value FROM g""")
def clip_polygon_hole(spark, sf_dir):
    """A rectangle with a hole, on the sparse raster; outlines in many points use the array form."""
    import numpy as np

    def ring(hx, hy):
        side = np.linspace(-1, 1, 25)
        path = [(s, -1) for s in side] + [(1, s) for s in side] + [(-s, 1) for s in side] + [(-1, -s) for s in side]
        return [(60000 + hx * a, 30000 + hy * b) for a, b in path]

    return op.clip(rasters.activity(spark, sf_dir), [{"type": "Polygon", "coordinates": [ring(30250, 20250), ring(10250, 5250)]}], drop=False).df


# ---- warping

_MERC = "l AS (SELECT 6378137 * radians(10) AS x0, 6378137 * radians(14) AS x1, 6378137 * atanh(sin(radians(48))) AS y0, 6378137 * atanh(sin(radians(50))) AS y1)"


@gate(f"""WITH {R1}, {_MERC}, t AS (SELECT i::INT AS row, j::INT AS col, degrees((x0 + (j + 0.5) * (x1 - x0) / 16) / 6378137) AS lon, degrees(asin(tanh((y1 - (i + 0.5) * (y1 - y0) / 20) / 6378137))) AS lat FROM l, range(20) a(i), range(16) b(j))
  SELECT r1.band, t.row, t.col, r1.value FROM t JOIN r1 ON r1.col = floor((lon - 10) / 0.5) AND r1.row = floor((50 - lat) / 0.25)""")
def reproject_nearest(spark, sf_dir):
    return op.reproject(rasters.tiles(spark, sf_dir), 3857, shape=(20, 16)).df


_MATCH = Affine(0.3, 0, 10.11, 0, -0.2, 49.93)


@gate(f"""WITH {R1}, t AS (SELECT i::INT AS row, j::INT AS col, 10.11 + (j + 0.5) * 0.3::DOUBLE AS lon, 49.93 - (i + 0.5) * 0.2::DOUBLE AS lat FROM range(9) a(i), range(12) b(j))
  SELECT r1.band, t.row, t.col, r1.value FROM t JOIN r1 ON lon > r1.x - 0.25 AND lon < r1.x + 0.25 AND lat > r1.y - 0.125 AND lat < r1.y + 0.125""")
def reproject_match(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    return op.reproject_match(g, g.meta.with_(width=12, height=9, transform=_MATCH)).df


def _grouped(expression, digits=9):
    return f"WITH {R3} SELECT band, (row // 16)::INT AS row, (col // 10)::INT AS col, round(({expression})::DOUBLE, {digits}) AS value FROM r3 GROUP BY 1, 2, 3"


def _resample(spark, sf_dir, method, digits=9):
    return _rounded(op.reproject(rasters.activity(spark, sf_dir), 3857, shape=(4, 12), resampling=method), digits)


for _name, _sql in {"average": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "rms": "sqrt(avg(value * value))", "med": "quantile_cont(value, 0.5)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)"}.items():
    _digits = 6 if _name in ("sum", "rms") else 9
    QUERIES[f"resample_{_name}"] = lambda spark, sf_dir, m=_name, d=_digits: _resample(spark, sf_dir, m, d)
    ORACLES[f"resample_{_name}"] = _grouped(_sql, _digits)


@gate(f"""WITH {R3}, v AS (SELECT band, (row // 16)::INT AS row, (col // 10)::INT AS col, floor(value / 100) AS value, count(*) AS n FROM r3 GROUP BY 1, 2, 3, 4)
  SELECT band, row, col, value::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY band, row, col ORDER BY n DESC, value) AS k FROM v) WHERE k = 1""")
def resample_mode(spark, sf_dir):
    g = rasters.activity(spark, sf_dir).map(lambda v: F.floor(v / 100).cast("double"))
    return op.reproject(g, 3857, shape=(4, 12), resampling="MODE").df


@gate(f"""WITH {R1}, t AS (SELECT i::INT AS row, j::INT AS col, 10.11 + (j + 0.5) * 0.3::DOUBLE AS lon, 49.93 - (i + 0.5) * 0.2::DOUBLE AS lat FROM range(9) a(i), range(12) b(j)),
  p AS (SELECT r1.band, t.row, t.col, (1 - abs(lon - x) / 0.5) * (1 - abs(lat - y) / 0.25) AS w, value FROM t JOIN r1 ON abs(lon - x) < 0.5 AND abs(lat - y) < 0.25)
  SELECT band, row, col, round(sum(w * value) / sum(w), 6) AS value FROM p GROUP BY 1, 2, 3""")
def resample_bilinear(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    return _rounded(op.reproject_match(g, g.meta.with_(width=12, height=9, transform=_MATCH), resampling="bilinear"))


def _covering(expression: str) -> str:
    """Of values with the parts w of their cells that targets cover, from edges in degrees."""
    return f"""WITH {R1}, t AS (SELECT i::INT AS row, j::INT AS col, 10.11 + j * 0.3::DOUBLE AS x0, 10.11 + (j + 1) * 0.3::DOUBLE AS x1, 49.93 - (i + 1) * 0.2::DOUBLE AS y0, 49.93 - i * 0.2::DOUBLE AS y1 FROM range(9) a(i), range(12) b(j)),
      p AS (SELECT r1.band, t.row, t.col, (least(x + 0.25, x1) - greatest(x - 0.25, x0)) / 0.5 AS a, (least(y + 0.125, y1) - greatest(y - 0.125, y0)) / 0.25 AS b, a * b AS w, value
        FROM t JOIN r1 ON x + 0.25 > x0 AND x - 0.25 < x1 AND y + 0.125 > y0 AND y - 0.125 < y1)
      SELECT band, row, col, round({expression}, 6) AS value FROM p WHERE a > 1e-9 AND b > 1e-9 GROUP BY 1, 2, 3"""


for _name, _sql in {"average": "sum(w * value) / sum(w)", "sum": "sum(w * value)", "rms": "sqrt(sum(w * value * value) / sum(w))", "max": "max(value)", "med": "quantile_cont(value, 0.5)"}.items():

    def _cover(spark, sf_dir, m=_name):
        g = rasters.tiles(spark, sf_dir)
        return _rounded(op.reproject_match(g, g.meta.with_(width=12, height=9, transform=_MATCH), resampling=m))

    QUERIES[f"resample_{_name}_partly"], ORACLES[f"resample_{_name}_partly"] = _cover, _covering(_sql)


_K = "CASE WHEN {0} <= 1 THEN 1.5 * {0} * {0} * {0} - 2.5 * {0} * {0} + 1 WHEN {0} < 2 THEN -0.5 * {0} * {0} * {0} + 2.5 * {0} * {0} - 4 * {0} + 2 ELSE 0 END"


@gate(f"""WITH {R1}, t AS (SELECT i::INT AS row, j::INT AS col, 10.11 + (j + 0.5) * 0.3::DOUBLE AS lon, 49.93 - (i + 0.5) * 0.2::DOUBLE AS lat FROM range(9) a(i), range(12) b(j)),
  p AS (SELECT r1.band, t.row, t.col, abs(lon - x) / 0.5 AS dx, abs(lat - y) / 0.25 AS dy, value FROM t JOIN r1 ON abs(lon - x) < 1 AND abs(lat - y) < 0.5),
  q AS (SELECT band, row, col, ({_K.format("dx")}) * ({_K.format("dy")}) AS w, value FROM p)
  SELECT band, row, col, round(sum(w * value) / sum(w), 6) AS value FROM q GROUP BY 1, 2, 3""")
def resample_cubic(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    return _rounded(op.reproject_match(g, g.meta.with_(width=12, height=9, transform=_MATCH), resampling="cubic"))


@gate(f"WITH {R1} SELECT r1.band, (row * 8 + a.i)::INT AS row, (col * 8 + b.j)::INT AS col, r1.value FROM r1, range(8) a(i), range(8) b(j)")
def upsample(spark, sf_dir):
    """To 64 x 64 a band: the index is shared by all bands."""
    return op.reproject(rasters.tiles(spark, sf_dir), 4326, shape=(64, 64)).df


# ---- mosaics: four overlapping quadrants of the sales raster, told apart by what is added

_QUADRANTS = [(Window(0, 7, 0, 31), 0), (Window(0, 7, 20, 50), 1000), (Window(5, 11, 0, 31), 2000), (Window(5, 11, 20, 50), 3000)]
_PARTS = "q AS (" + " UNION ALL ".join(f"SELECT band, row, col, value + {add} AS value, {k} AS k FROM r2 WHERE row >= {w.row_start} AND row < {w.row_stop} AND col >= {w.col_start} AND col < {w.col_stop}" for k, (w, add) in enumerate(_QUADRANTS)) + ")"


def _quadrants(spark, sf_dir) -> list[Grid]:
    g = rasters.sales(spark, sf_dir)
    return [op.isel_window(g, w).map(lambda v, a=add: v + F.lit(a).cast("long")) for w, add in _QUADRANTS]


for _name, _sql in {"first": "arg_min(value, k)", "last": "arg_max(value, k)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)::BIGINT", "count": "count(*)"}.items():
    QUERIES[f"merge_{_name}"] = lambda spark, sf_dir, m=_name: op.merge_arrays(_quadrants(spark, sf_dir), method=m).df
    ORACLES[f"merge_{_name}"] = f"WITH {R2}, {_PARTS} SELECT band, row, col, {_sql} AS value FROM q GROUP BY band, row, col"


@gate(f"WITH {R2}, {_PARTS} SELECT band, row, col, (max(value) - min(value))::BIGINT AS value FROM q GROUP BY band, row, col")
def merge_custom(spark, sf_dir):
    return op.merge_arrays(_quadrants(spark, sf_dir), method=lambda values: F.array_max(values) - F.array_min(values)).df


@gate(f"WITH {R2}, {_PARTS} SELECT band, row, col, arg_min(value, k) AS cents, arg_min(value * 2, k) AS twice FROM q GROUP BY band, row, col")
def merge_multi_var(spark, sf_dir):
    sets = [GridSet({"cents": g, "twice": g.map(lambda v: v * 2)}, {}) for g in _quadrants(spark, sf_dir)]
    return op.merge_datasets(sets).wide()


@gate(f"""WITH {R1}, t AS (SELECT i::INT AS row, j::INT AS col, 10 + (j + 0.5) * 0.4::DOUBLE AS lon, 50 - (i + 0.5) * 0.4::DOUBLE AS lat FROM range(5) a(i), range(10) b(j))
  SELECT r1.band, t.row, t.col, r1.value FROM t JOIN r1 ON r1.col = floor((lon - 10) / 0.5 + 1e-9) AND r1.row = floor((50 - lat) / 0.25 + 1e-9)""")
def merge_res(spark, sf_dir):
    return op.merge_arrays([rasters.tiles(spark, sf_dir)], res=0.4).df


# ---- gap filling


@gate(f"""WITH {R4}, a AS (SELECT i::INT AS row, j::INT AS col FROM range(25) r(i), range(50) c(j)), m AS (SELECT a.* FROM a LEFT JOIN r4 USING (row, col) WHERE r4.value IS NULL),
  n AS (SELECT m.row, m.col, r4.value, row_number() OVER (PARTITION BY m.row, m.col ORDER BY (m.row - r4.row) * (m.row - r4.row) + (m.col - r4.col) * (m.col - r4.col), r4.row, r4.col) AS k FROM m, r4)
  SELECT 1 AS band, row, col, value FROM n WHERE k = 1 UNION ALL SELECT band, row, col, value FROM r4""")
def interpolate_nearest(spark, sf_dir):
    g = rasters.parts(spark, sf_dir)
    # Unit cells keep squared distances whole, so ties are ties on both sides.
    return op.interpolate_na(g.with_(transform=Affine(1, 0, 0, 0, -1, 25)), "nearest").df


@gate()
def interpolate_linear(spark, sf_dir):
    return op.interpolate_na(rasters.parts(spark, sf_dir).astype("float64"), "linear").df


@gate()
def interpolate_cubic(spark, sf_dir):
    return op.interpolate_na(rasters.parts(spark, sf_dir).astype("float64"), "cubic").df


# ---- map algebra


@gate(f"WITH {R1} SELECT a.band, a.row, a.col, a.value + b.value AS value FROM r1 a JOIN r1 b ON a.band = b.band AND a.row = b.row AND a.col = 7 - b.col")
def algebra_add(spark, sf_dir):
    g = rasters.tiles(spark, sf_dir)
    return op.align(g, op.isel(g, col=slice(None, None, -1)), lambda a, b: a + b).df


@gate(f"WITH {R2} SELECT a.row, a.col, round((a.value - b.value)::DOUBLE / (a.value + b.value), 9) AS value FROM r2 a JOIN r2 b USING (row, col) WHERE a.band = 2 AND b.band = 1")
def ndvi_like(spark, sf_dir):
    wide = op.bands_as_columns(rasters.sales(spark, sf_dir), [1, 2])
    return wide.select("row", "col", F.round((F.col("band_2") - F.col("band_1")) / (F.col("band_2") + F.col("band_1")), 9).alias("value")).where("value is not null")


@gate(f"WITH {R2} SELECT row, col, value > 20000000 AS high FROM r2 WHERE band = 2")
def threshold(spark, sf_dir):
    g = op.isel(rasters.sales(spark, sf_dir), band=1)
    return g.df.select("row", "col", (F.col("value") > 20000000).alias("high"))


@gate(f"WITH {R1} SELECT (b.row % 3)::INT AS zone, round(sum(a.value), 6) AS sum, round(avg(a.value), 9) AS mean, min(a.value) AS min, max(a.value) AS max, count(*) AS count FROM r1 a JOIN (SELECT DISTINCT row, col FROM r1) b USING (row, col) GROUP BY 1")
def zonal_mean(spark, sf_dir):
    from gridloom.operators.warp import target_cells

    g = rasters.tiles(spark, sf_dir)
    zones = target_cells(spark, g.meta.transform, 8, 8).select(F.lit(1).alias("band"), "row", "col", (F.col("row") % 3).alias("value"))
    out = op.zonal(g, Grid(zones, g.meta.with_(dtype="int32")))
    return out.select("zone", F.round("sum", 6).alias("sum"), F.round("mean", 9).alias("mean"), "min", "max", "count")


@gate(f"WITH {R1} SELECT band, row, round(avg(value), 9) AS mean FROM r1 GROUP BY band, row")
def reduce_dim(spark, sf_dir):
    return op.reduce_dim(rasters.tiles(spark, sf_dir), "x").select("band", "row", F.round("mean", 9).alias("mean"))


@gate(f"WITH {R2} SELECT band, sum(value)::BIGINT AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) AS count FROM r2 GROUP BY band")
def band_stats(spark, sf_dir):
    return op.band_stats(rasters.sales(spark, sf_dir)).select("band", "sum", F.round("mean", 6).alias("mean"), "min", "max", "count")


# ---- tags and times


@gate("SELECT r_regionkey, [r_regionkey::DOUBLE, r_regionkey + 0.5] AS vector FROM region")
def tag_vectors(spark, sf_dir):
    tag = F.concat(F.lit("{"), F.col("r_regionkey"), F.lit(","), F.col("r_regionkey") + F.lit(0.5).cast("decimal(2,1)"), F.lit("}"))
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", cell.tag_vector(tag).alias("vector"))


@gate("SELECT n_nationkey, TIMESTAMP '2016-12-19 10:27:29.687763' + to_microseconds((n_nationkey * 872712659688)::BIGINT) AS at FROM nation")
def cf_times(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", cell.cf_time(F.col("n_nationkey") * F.lit(872712.659688), "seconds since 2016-12-19T10:27:29.687763").alias("at"))


# ---- control points, rational polynomials, coordinate arrays


@gate(f"WITH {R4} SELECT band, row, col, value FROM r4")
def warp_by_gcps(spark, sf_dir):
    """Four control points give the raster's own grid, so every cell comes back."""
    g = rasters.parts(spark, sf_dir)
    corners = [{"row": r, "col": c, "x": -5 + 0.1 * c, "y": 50 - 0.1 * r} for r in (0, 25) for c in (0, 50)]
    return op.reproject(g.with_(transform=Affine()), 4326, gcps=corners, transform=g.meta.transform, shape=(25, 50)).df


@gate(f"WITH {R4} SELECT band, row, col, value FROM r4")
def warp_by_rpcs(spark, sf_dir):
    """A linear model written as rational polynomials: line = (50 - lat) / 0.1, sample = (lon + 5) / 0.1, at centres."""
    one, g = [1.0] + [0.0] * 19, rasters.parts(spark, sf_dir)
    rpcs = {"line_off": 12, "line_scale": 12.5, "samp_off": 24.5, "samp_scale": 25, "lat_off": 48.75, "lat_scale": 1.25, "long_off": -2.5, "long_scale": 2.5, "height_off": 0, "height_scale": 1}
    rpcs |= {"line_num_coeff": [0, 0, -1.0] + [0.0] * 17, "line_den_coeff": one, "samp_num_coeff": [0, 1.0] + [0.0] * 18, "samp_den_coeff": one}
    return op.reproject(g.with_(transform=Affine()), 4326, rpcs=rpcs, transform=g.meta.transform, shape=(25, 50)).df


@gate(f"WITH {R4} SELECT band, 24 - row AS row, col, value FROM r4")
def warp_by_places(spark, sf_dir):
    """A coordinate array that turns the raster upside down."""
    from gridloom.operators.warp import target_cells

    g = rasters.parts(spark, sf_dir)
    places = target_cells(spark, g.meta.transform, 50, 25).select("row", "col", (-5 + 0.1 * (F.col("col") + 0.5)).alias("x"), (47.5 + 0.1 * (F.col("row") + 0.5)).alias("y"))
    return op.reproject(g, 4326, src_geoloc_array=places, transform=g.meta.transform, shape=(25, 50)).df


# ---- sinks and sources: written to the shared folder and read again


@gate(f"WITH {R4} SELECT band, row, col, value FROM r4")
def parquet_round_trip(spark, sf_dir):
    from gridloom.sources.scratch import scratch
    from gridloom.sources.tables import read_cells, write_cells

    path = scratch(spark, "cells")
    write_cells(rasters.parts(spark, sf_dir), path, tile=16)
    return read_cells(spark, path).df


@gate(f"WITH {R4} SELECT band, row, col, value::DOUBLE AS value FROM r4 WHERE row BETWEEN 3 AND 20 AND col < 40")
def tiff_round_trip(spark, sf_dir):
    """One file; a window of it is read through the data source, which skips the other blocks."""
    from gridloom.sources.raster_sink import to_raster
    from gridloom.sources.raster_source import open_raster
    from gridloom.sources.scratch import scratch

    path = scratch(spark, "parts.tif")
    to_raster(rasters.parts(spark, sf_dir), path, dtype="int32", blocksize=16)
    cells = open_raster(spark, path, masked=True).valid()
    return cells.where(F.col("row").between(3, 20) & (F.col("col") < 40))


@gate(f"WITH {R2} SELECT band, row, col, value::DOUBLE AS value FROM r2")
def tile_folder_round_trip(spark, sf_dir):
    """A file for each tile, written by the tasks; read together as a mosaic."""
    from gridloom.sources.raster_sink import write_tiles
    from gridloom.sources.raster_source import open_raster
    from gridloom.sources.scratch import scratch

    files = write_tiles(rasters.sales(spark, sf_dir).astype("float64"), scratch(spark, "tiles"), tile=32)
    return op.merge_arrays([open_raster(spark, p) for p in sorted(files["path"])]).df


@gate(f"WITH {R4} SELECT band, row, col, value::INT AS value FROM r4")
def ascii_round_trip(spark, sf_dir):
    from gridloom.sources.raster_sink import to_raster
    from gridloom.sources.raster_source import open_raster
    from gridloom.sources.scratch import scratch

    path = scratch(spark, "parts.asc")
    to_raster(rasters.parts(spark, sf_dir), path, dtype="int32")
    g = open_raster(spark, path)
    return g.valid()


@gate(f"WITH {R4} SELECT band, row, col, value::DOUBLE AS value FROM r4")
def tile_table_round_trip(spark, sf_dir):
    from gridloom.sources.tables import from_tiles, to_tiles

    g = rasters.parts(spark, sf_dir)
    return from_tiles(to_tiles(g, 8), g.meta).df
