"""Writing rasters to files.

A Spark job makes the tiles; the file formats need one file, so the driver
(or, for a folder of tiles, each task) puts them in place.  ``write_tiles`` is
the way for rasters that are larger than the driver's memory.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.errors import RasterError
from gridloom.functions import cells as cell
from gridloom.plans.grid import Grid, GridSet
from gridloom.plans.meta import exact_nodata
from gridloom.sources import asciigrid
from gridloom.sources.geotiff import tiff_bytes

_NUMPY = {"float16": "float16", "float32": "float32", "float64": "float64"}


def stored_type(grid: Grid, dtype: str | None = None) -> str:
    """The type on disk: the given one, else the encoding's, else the raster's."""
    return dtype or grid.meta.encoding.get("dtype") or grid.meta.dtype


def encoded(grid: Grid, dtype: str | None = None) -> Grid:
    """Values as they are stored: scale and offset undone, null as the missing value, exact in the type."""
    m, kind = grid.meta, stored_type(grid, dtype)
    nodata = m.encoded_nodata if m.encoded_nodata is not None else m.found_nodata()
    if nodata is not None and not (nodata != nodata and not kind.startswith("float")):
        nodata = exact_nodata(nodata, kind)
    elif nodata is not None:
        raise OverflowError(f"missing value {nodata} does not fit in {kind}")
    value = F.col(grid.value)
    scale, offset = float(m.encoding.get("scale_factor", 1.0)), float(m.encoding.get("add_offset", 0.0))
    if (scale, offset) != (1.0, 0.0):
        value = (value - offset) / scale
    if not kind.startswith("float"):
        value = F.round(value)
    if nodata is not None:
        value = cell.unmask(value, nodata, kind)
    return Grid(grid.df.withColumn(grid.value, value), m.with_(dtype=kind, nodata=None if nodata is None else nodata, encoded_nodata=None, attrs={k: v for k, v in m.attrs.items() if k != "_FillValue"}))


def to_array(grid: Grid) -> np.ndarray:
    """(bands, rows, columns) on the driver; absent cells hold the missing value (0 where there is none)."""
    m = grid.meta
    pdf = grid.df.where(F.col(grid.value).isNotNull()).toPandas()
    nodata = m.found_nodata()
    out = np.full((m.count, *m.shape), 0 if nodata is None else nodata, m.dtype)
    place = {b: k for k, b in enumerate(m.bands)}
    out[pdf["band"].map(place).to_numpy(int), pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)] = pdf[grid.value].to_numpy()
    return out


def _put(path: str, data: bytes) -> None:
    """Write under another name, then move, so that a reader sees a whole file or none."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if "/" in base:
        where.create_dir(base.rpartition("/")[0], recursive=True)
    temp = f"{base}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(temp) as out:
        out.write(data)
    where.move(temp, base)


def raster_bytes(grid: Grid, driver: str = "GTiff", dtype=None, tags=None, recalc_transform=True, **profile) -> bytes:
    """A raster as the bytes of a file."""
    ready = encoded(grid, dtype)
    meta = ready.meta.with_(transform=ready.meta.recalculated_transform()) if recalc_transform else ready.meta
    data = to_array(Grid(ready.df, meta))
    if driver == "AAIGrid":
        if len(data) != 1:
            raise RasterError("an ASCII grid has one band")
        return asciigrid.render(data[0], meta).encode()
    if driver != "GTiff":
        raise ValueError(f"no writer for {driver!r}; known: GTiff, AAIGrid")
    n, attrs, encoding = meta.count, grid.meta.attrs, grid.meta.encoding
    many = lambda v: None if v is None else list(v) if isinstance(v, (list, tuple)) else [v] * n
    names = many(attrs.get("long_name"))
    plain = {k: v for k, v in (attrs | (tags or {})).items() if k not in ("long_name", "units", "_FillValue", "scale_factor", "add_offset", "scale_factors", "add_offsets") and not isinstance(v, dict)}
    scales, offsets = many(encoding.get("scale_factor", attrs.get("scale_factors", attrs.get("scale_factor")))), many(encoding.get("add_offset", attrs.get("add_offsets", attrs.get("add_offset"))))
    return tiff_bytes(data, meta, tile=profile.get("blocksize", 256), compress=(profile.get("compress", "deflate") or "").lower() or None, predictor=int(profile.get("predictor", 1)), tags=plain, scales=scales, offsets=offsets, descriptions=names, units=many(attrs.get("units")))


def driver_of(path: str) -> str:
    ending = path.rpartition(".")[2].lower()
    found = {"tif": "GTiff", "tiff": "GTiff", "asc": "AAIGrid"}.get(ending)
    if found is None:
        raise ValueError(f"can't tell a format from {path!r}; give driver")
    return found


def to_raster(grid: Grid | GridSet, path: str, *, driver=None, dtype=None, tags=None, recalc_transform=True, compute=True, **profile):
    """Write a raster, or the variables of a set as its bands; with ``compute=False`` returns what does it."""
    if isinstance(grid, GridSet):
        grid = stacked(grid)
    if grid.meta.rpcs is not None and not isinstance(grid.meta.rpcs, dict):
        raise TypeError("rational polynomials must be a mapping")

    def run() -> None:
        _put(path, raster_bytes(grid, driver or driver_of(path), dtype, tags, recalc_transform, **profile))

    return run() if compute else run


def stacked(grids: GridSet) -> Grid:
    """Variables as bands, which must agree on the missing value; each keeps its scale and offset."""
    metas = [g.meta for g in grids.grids.values()]
    missing = {repr(m.encoded_nodata if m.encoded_nodata is not None else m.found_nodata()) for m in metas}
    if len(missing) > 1:
        raise RasterError(f"variables have different missing values: {sorted(missing)}")
    out = grids.to_array()
    encoding = dict(metas[0].encoding)
    for name, plain in (("scale_factor", 1.0), ("add_offset", 0.0)):
        values = [m.encoding.get(name, m.attrs.get(name, plain)) for m in metas]
        if any(v != plain for v in values):
            out = out.with_(attrs=out.meta.attrs | {f"{name}s": values})
            encoding.pop(name, None)
    return out.with_(encoding=encoding, attrs=out.meta.attrs | {"long_name": [g.meta.attrs.get("long_name", k) for k, g in grids.grids.items()]})


def write_tiles(grid: Grid, folder: str, *, tile: int = 512, dtype=None) -> pd.DataFrame:
    """A folder of TIFF files, one for each tile, each written by the task that has its cells; returns their list.

    A tile's cells come together in one task of bounded size; a file appears
    whole, and a task that runs again writes the same file.
    """
    ready = encoded(grid, dtype)
    m, value = ready.meta, ready.value

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        h, w = min(tile, m.height - tr * tile), min(tile, m.width - tc * tile)
        nodata = m.found_nodata()
        data = np.full((m.count, h, w), 0 if nodata is None else nodata, m.dtype)
        place = {b: k for k, b in enumerate(m.bands)}
        data[pdf["band"].map(place), pdf["row"] - tr * tile, pdf["col"] - tc * tile] = pdf[value]
        own = m.with_(width=w, height=h, transform=m.transform.shifted(tc * tile, tr * tile))
        path = f"{folder}/tile_{tr}_{tc}.tif"
        _put(path, tiff_bytes(data, own))
        return pd.DataFrame({"tr": [tr], "tc": [tc], "path": [path]})

    cells = ready.df.where(F.col(value).isNotNull()).withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
    return cells.groupBy("tr", "tc").applyInPandas(write, "tr int, tc int, path string").toPandas()
