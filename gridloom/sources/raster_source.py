"""A Spark data source for raster files: one partition for each run of blocks, cells as rows.

``spark.read.format("raster").load(path)`` after ``register(spark)``.  Filters
on band, row and col choose the blocks that are read at all.  Files are opened
inside each task through Arrow's file systems, so no handle, cache or lock is
shared.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.errors import RasterError
from gridloom.functions import cells as cell
from gridloom.operators.algebra import bands_as_columns
from gridloom.plans.grid import Grid, GridSet, from_wide
from gridloom.plans.meta import SPARK_TYPE, GridMeta
from gridloom.sources import asciigrid
from gridloom.sources.geotiff import TiffReader


def open_file(path: str):
    """A random-access file by path or URI."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(base)


class _Ascii:
    """An ASCII grid with the interface of TiffReader: a block is 256 rows."""

    def __init__(self, file):
        self.data, self._meta = asciigrid.parse(file.read().decode())
        self.height, self.width = self.data.shape
        self.block, self.samples, self.directories = (min(256, self.height), self.width), 1, 1

    def meta(self, name="value") -> GridMeta:
        return self._meta.with_(name=name)

    def grid_of_blocks(self):
        return -(-self.height // self.block[0]), 1

    def read_block(self, band, row, col):
        return self.data[row * self.block[0] : (row + 1) * self.block[0]]


def open_reader(file, path: str = "", level: int | None = None):
    """The reader for a file, by its first bytes; ``level`` is an overview's number, from 0."""
    file = io.BytesIO(file) if isinstance(file, (bytes, bytearray)) else file
    first = file.read(4)
    file.seek(0)
    if first[:2] in (b"II", b"MM"):
        return TiffReader(file, 0 if level is None else level + 1)
    if first.lower().startswith((b"ncol", b"nrow")):
        return _Ascii(file)
    raise RasterError(f"{path or 'the file'} is neither a TIFF nor an ASCII grid")


class BlockRun(InputPartition):
    def __init__(self, band: int, row: int, cols: tuple[int, int]):
        super().__init__(None)
        self.band, self.row, self.cols = band, row, cols


class RasterReader(DataSourceReader):
    def __init__(self, path: str, level, run: int):
        self.path, self.level, self.run = path, level, run
        with open_file(path) as f:
            r = open_reader(f, path, level)
            self.blocks, self.block, self.samples = r.grid_of_blocks(), r.block, r.samples
        self.limits = {"band": [1, r.samples], "row": [0, r.height - 1], "col": [0, r.width - 1]}

    def pushFilters(self, filters):
        """Ranges on band, row and col narrow what is read; Spark checks all filters again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.limits:
                low, high = self.limits[name]
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                elif isinstance(f, In) and f.value:
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                self.limits[name] = [low, high]
            yield f

    def partitions(self):
        (b0, b1), (r0, r1), (c0, c1) = self.limits["band"], self.limits["row"], self.limits["col"]
        if b0 > b1 or r0 > r1 or c0 > c1:
            return []
        bh, bw = self.block
        cols = range(c0 // bw, c1 // bw + 1)
        return [BlockRun(b - 1, r, (c, min(c + self.run, cols.stop))) for b in range(b0, b1 + 1) for r in range(r0 // bh, r1 // bh + 1) for c in range(cols.start, cols.stop, self.run)] or []

    def read(self, part: BlockRun):
        if part is None:
            return
        with open_file(self.path) as f:
            r = open_reader(f, self.path, self.level)
            for c in range(*part.cols):
                data = r.read_block(part.band, part.row, c)
                rows, cols = np.indices(data.shape, np.int32)
                value = data.ravel()
                value = value.astype({"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}.get(value.dtype.str[1:], value.dtype))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(value.size, part.band + 1, np.int32)), pa.array((rows + part.row * r.block[0]).ravel()), pa.array((cols + c * r.block[1]).ravel()), pa.array(value)], ["band", "row", "col", "value"]
                )


class RasterSource(DataSource):
    """Options: path, overview_level, blocks_per_partition (default 4)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        with open_file(self.options["path"]) as f:
            kind = open_reader(f).meta().dtype
        return f"band int, row int, col int, value {SPARK_TYPE[kind]}"

    def reader(self, schema) -> RasterReader:
        level = self.options.get("overview_level")
        return RasterReader(self.options["path"], None if level is None else int(level), int(self.options.get("blocks_per_partition", 4)))


def register(spark: SparkSession) -> None:
    """Make the source known; filters reach Python sources only with the switch that is set here."""
    from gridloom.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def blocks_per_task(chunks, reader, size: int = 128 << 20) -> int:
    """A number of blocks as it is; for "auto" or True as many whole blocks as ``size`` bytes hold."""
    if isinstance(chunks, int) and not isinstance(chunks, bool):
        return chunks
    if chunks is not True and chunks != "auto":
        raise ValueError(f"chunks must be a number of blocks, 'auto' or True, not {chunks!r}")
    return max(1, size // (reader.block[0] * reader.block[1] * 8))


def read_token(path: str, chunks=None) -> str:
    """A name for what a scan reads: the same for one file, time of change and chunks, in every session."""
    import hashlib

    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = where.get_file_info(base)
    return hashlib.sha256(repr((path, info.mtime_ns, info.size, chunks)).encode()).hexdigest()


def open_raster(spark: SparkSession, source, *, masked=False, mask_and_scale=False, band_as_variable=False, overview_level=None, chunks=None, cache=False, name="value", parse_coordinates=True, unsigned=None, warp=None) -> Grid | GridSet:
    """A raster file as a Grid, lazily; as a set with a variable for each band with ``band_as_variable``.

    ``source``: a path or URI, an open binary file, or bytes (these two for
    rasters that fit in a message).  ``masked`` makes missing cells null and
    moves the missing value to the encoding; ``mask_and_scale`` also applies
    scales and offsets, by band, and reads bytes marked unsigned as such.
    ``chunks`` is the number of file blocks for a task, or "auto".
    ``warp`` holds arguments of ``reproject``, applied lazily.
    """
    if isinstance(source, (bytes, bytearray)) or hasattr(source, "read"):
        r = open_reader(source if isinstance(source, (bytes, bytearray)) else source.read(), level=overview_level)
        meta, frames = r.meta(name), []
        for b in range(r.samples):
            for i in range(r.grid_of_blocks()[0]):
                for j in range(r.grid_of_blocks()[1]):
                    data = r.read_block(b, i, j)
                    rows, cols = np.indices(data.shape, np.int32)
                    frames.append(pa.table({"band": pa.array(np.full(data.size, b + 1, np.int32)), "row": (rows + i * r.block[0]).ravel(), "col": (cols + j * r.block[1]).ravel(), "value": data.ravel().astype("int64" if data.dtype.kind in "ui" else data.dtype)}))
        df = spark.createDataFrame(pa.concat_tables(frames)).withColumn("value", F.col("value").cast(SPARK_TYPE[meta.dtype]))
    else:
        register(spark)
        with open_file(source) as f:
            r = open_reader(f, source, overview_level)
            meta = r.meta(name)
            if overview_level is not None:  # levels have no place of their own
                f.seek(0)
                full = open_reader(f, source).meta(name)
                t, sx, sy = full.transform, full.width / meta.width, full.height / meta.height
                meta = full.with_(width=meta.width, height=meta.height, transform=t._replace(a=t.a * sx, b=t.b * sy, d=t.d * sx, e=t.e * sy))
        reader = spark.read.format("raster").option("path", source)
        if overview_level is not None:
            reader = reader.option("overview_level", str(overview_level))
        if chunks:
            reader = reader.option("blocks_per_partition", str(blocks_per_task(chunks, r)))
        df = reader.load()
    meta = meta.with_(has_coords=parse_coordinates)
    if masked or mask_and_scale:
        nodata = meta.found_nodata()
        value, kind = F.col("value"), meta.dtype
        if mask_and_scale:
            if unsigned if unsigned is not None else str(meta.attrs.get("_Unsigned", "")).lower() == "true":
                value, kind = cell.as_unsigned(value, kind), "u" + kind.removeprefix("u")
                if nodata is not None and nodata < 0:
                    nodata += 2 ** int(kind[4:])
            n = meta.count
            scales = meta.attrs.get("scale_factors") or [meta.attrs.get("scale_factor", 1.0)] * n
            offsets = meta.attrs.get("add_offsets") or [meta.attrs.get("add_offset", 0.0)] * n
            value = cell.decode(value, scales[0], offsets[0], nodata) if len(set(zip(scales, offsets))) == 1 else cell.decode_by_band(value, F.col("band"), scales, offsets, nodata)
        else:
            value = cell.mask(value, nodata)
        from gridloom.sources.tags import to_encoding

        attrs, encoding = to_encoding(meta.attrs, True)
        df = df.withColumn("value", value)
        meta = meta.with_(attrs=attrs, encoding=encoding | {"dtype": kind}, dtype="float64", nodata=None, encoded_nodata=nodata)
    grid = Grid(df, meta)
    if warp:
        from gridloom.operators import reproject

        grid = reproject(grid, **warp)
    if cache:
        grid = grid.persist()
    if band_as_variable:
        return from_wide(bands_as_columns(grid).withColumn("band", F.lit(1)).select("band", "row", "col", *[f"band_{b}" for b in meta.bands]), meta.with_(bands=(1,)))
    return grid


def open_variables(spark: SparkSession, paths: dict[str, str], *, groups=None, variables=None, **options) -> GridSet | list[GridSet]:
    """Files of a container, by the names of their subdatasets: a set for each shape, a single one unwrapped."""
    import re

    from gridloom.sources.tags import variable_pattern

    pattern = re.compile(variable_pattern(groups, variables))
    by_shape: dict[tuple, dict] = {}
    for name, path in paths.items():
        if pattern.search(name):
            grid = open_raster(spark, path, name=re.split(r"[:/]", name)[-1], **options)
            by_shape.setdefault(grid.meta.shape, {})[grid.meta.name] = grid
    sets = [GridSet(g, {}) for g in by_shape.values()]
    return sets[0] if len(sets) == 1 else sets


def open_dataset(spark: SparkSession, path: str, *, drop_variables=(), mask_and_scale=True, decode_coords="all", name="band_data", **options) -> GridSet:
    """A raster file as a set with one variable; refuses what it could not return as one set."""
    if decode_coords not in (True, "all"):
        raise ValueError("decode_coords must be 'all'")
    grid = open_raster(spark, path, mask_and_scale=mask_and_scale, name=name, **options)
    found = grid.grids if isinstance(grid, GridSet) else {name: grid}
    dropped = [drop_variables] if isinstance(drop_variables, str) else list(drop_variables or ())
    return GridSet({k: g for k, g in found.items() if k not in dropped}, {})
