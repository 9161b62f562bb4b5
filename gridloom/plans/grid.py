"""Rasters as DataFrames of cells, and sets of them.

A Grid is cells (band, row, col, value) with a GridMeta on the driver.  A cell
that is absent or null is missing.  Every operation returns a new Grid whose
plan is lazy; window shifts are integer offsets, so that Catalyst merges a
chain of them into one projection and pushes filters on row, col and band to
the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import MissingCrs, MissingSpatialDimension, RasterError, SingleVariableExpected
from gridloom.functions.affine import Affine
from gridloom.functions.crs import Crs
from gridloom.options import get_option
from gridloom.plans.meta import GridMeta

KEYS = ("band", "row", "col")


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    meta: GridMeta

    def with_(self, df: DataFrame | None = None, **changes) -> "Grid":
        return Grid(df if df is not None else self.df, self.meta.with_(**changes) if changes else self.meta)

    @property
    def values(self) -> list[str]:
        """The value columns: all but the cell's keys."""
        return [c for c in self.df.columns if c not in KEYS]

    @property
    def value(self) -> str:
        if len(self.values) != 1:
            raise SingleVariableExpected(f"one value column is needed, there are {self.values}")
        return self.values[0]

    def valid(self) -> DataFrame:
        """Cells that are not missing."""
        nodata = self.meta.found_nodata()
        v = F.col(self.value)
        keep = v.isNotNull()
        if self.meta.dtype.startswith("float"):
            keep &= ~F.isnan(v)
        if nodata is not None and nodata == nodata:
            keep &= v != F.lit(nodata)
        return self.df.where(keep)

    def with_coords(self) -> DataFrame:
        """Cells with x and y of their centres (xc, yc in a grid that is not rectilinear)."""
        x, y = center_columns(self.meta.transform)
        names = (self.meta.x_dim, self.meta.y_dim) if self.meta.transform.rectilinear else ("xc", "yc")
        return self.df.select("*", x.alias(names[0]), y.alias(names[1]))

    def map(self, expression) -> "Grid":
        """A new value for each cell, from a function of the value's Column."""
        return self.with_(self.df.select(*KEYS, expression(F.col(self.value)).alias(self.value)))

    def astype(self, dtype: str) -> "Grid":
        from gridloom.plans.meta import SPARK_TYPE

        return Grid(self.df.withColumn(self.value, F.col(self.value).cast(SPARK_TYPE[dtype])), self.meta.with_(dtype=dtype))

    def squeeze(self) -> "Grid":
        """Without the extra dimension, if it has a single place."""
        return self.with_(extra_dim=None) if self.meta.count == 1 else self

    def assign_transform(self, transform: Affine) -> "Grid":
        """The same cells at other coordinates."""
        return self.with_(transform=transform, has_coords=True)

    def rename(self, name: str) -> "Grid":
        return Grid(self.df.withColumnRenamed(self.value, name), self.meta.with_(name=name))

    def where(self, condition, other=None) -> "Grid":
        """Values where a condition on the value's Column holds; elsewhere missing, or ``other``."""
        return self.map(lambda v: F.when(condition(v), v).otherwise(F.lit(other)))

    def fillna(self, value) -> "Grid":
        """Null values replaced (absent cells stay absent; see ``operators.warp.densify``)."""
        return self.map(lambda v: F.coalesce(v, F.lit(value)))

    def persist(self) -> "Grid":
        return self.with_(self.df.persist())


def center_columns(t: Affine) -> tuple[Column, Column]:
    col, row = F.col("col") + 0.5, F.col("row") + 0.5
    x, y = col * t.a + t.c, row * t.e + t.f
    if t.b:
        x = col * t.a + row * t.b + t.c
    if t.d:
        y = col * t.d + row * t.e + t.f
    return x, y


@dataclass(frozen=True)
class GridSet:
    """Named rasters, and what else a dataset holds: variables without spatial dimensions, carried along.

    ``others`` maps a name to (number of dimensions, value).
    """

    grids: dict[str, Grid]
    others: dict = None

    @property
    def vars(self) -> list[str]:
        return [*self.grids, *(self.others or {})]

    @property
    def crs(self) -> Crs:
        found = {g.meta.crs for g in self.grids.values() if g.meta.crs is not None}
        if len(found) > 1:
            raise RasterError(f"variables have different coordinate reference systems: {sorted(map(str, found))}")
        if not found:
            raise MissingCrs("no variable has a coordinate reference system")
        return next(iter(found))

    @property
    def grid_mapping(self) -> str:
        found = {g.meta.grid_mapping for g in self.grids.values()}
        if len(found) > 1:
            raise RasterError(f"variables have different grid mappings: {sorted(found)}")
        return next(iter(found), "spatial_ref")

    def drop_vars(self, *names: str) -> "GridSet":
        return GridSet({k: g for k, g in self.grids.items() if k not in names}, {k: v for k, v in (self.others or {}).items() if k not in names})

    def each(self, operation) -> "GridSet":
        """Apply an operation to every raster; variables without spatial dimensions pass, unless they have two or more
        and the option does not let them."""
        for name, (dims, _) in (self.others or {}).items():
            if dims >= 2 and not get_option("skip_missing_spatial_dims"):
                raise MissingSpatialDimension(f"variable {name!r} has no spatial dimensions")
        return GridSet({k: operation(g) for k, g in self.grids.items()}, self.others)

    def __getattr__(self, name: str):
        """clip_box, clip, pad_box, reproject, reproject_match and interpolate_na of every raster."""
        from gridloom import operators

        if name not in operators.DATASET_OPERATIONS:
            raise AttributeError(name)
        operation = operators.DATASET_OPERATIONS[name]
        return lambda *args, **kw: self.each(lambda g: operation(g, *args, **kw))

    def wide(self) -> DataFrame:
        """One row for each cell with a column for each variable, for rasters on one grid."""
        frames = [g.df.select(*KEYS, F.col(g.value).alias(k)) for k, g in self.grids.items()]
        return reduce(lambda a, b: a.join(b, list(KEYS), "full_outer"), frames)

    def to_array(self) -> Grid:
        """Variables stacked as bands, in order."""
        frames = [g.df.select(F.lit(k).alias("band"), "row", "col", F.col(g.value).alias("value")) for k, g in enumerate(self.grids.values(), 1)]
        first = next(iter(self.grids.values())).meta
        return Grid(reduce(DataFrame.unionByName, frames), first.with_(bands=tuple(range(1, len(frames) + 1)), extra_dim="variable", attrs=first.attrs | {"long_name": list(self.grids)}))


def from_wide(df: DataFrame, meta: GridMeta, names: list[str] | None = None) -> GridSet:
    names = names or [c for c in df.columns if c not in KEYS]
    return GridSet({k: Grid(df.select(*KEYS, k), meta.with_(name=k)) for k in names}, {})
