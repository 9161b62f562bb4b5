"""Map algebra and reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.grid import KEYS, Grid


def align(left: Grid, right: Grid, expression) -> Grid:
    """A value from two rasters on one grid, where both have one: an equi-join on integer places."""
    if left.meta.shape != right.meta.shape:
        raise ValueError(f"rasters of shapes {left.meta.shape} and {right.meta.shape} are not on one grid")
    a = left.valid().select(place_key(left.meta).alias("key"), F.col(left.value).alias("a"))
    b = right.valid().select(place_key(left.meta).alias("key"), F.col(right.value).alias("b"))
    return left.with_(a.join(b, "key").select(*places_of(left.meta), expression(F.col("a"), F.col("b")).alias(left.value)))


def place_key(meta) -> Column:
    """Band, row and col as one number: a join on it sorts by the whole key at once and moves fewer bytes."""
    return (F.col("band").cast("long") * meta.height + F.col("row")) * meta.width + F.col("col")


def places_of(meta) -> list[Column]:
    line = F.expr(f"key div {meta.width}")
    return [F.expr(f"key div {meta.width * meta.height}").cast("int").alias("band"), F.pmod(line, F.lit(meta.height)).cast("int").alias("row"), F.pmod("key", F.lit(meta.width)).cast("int").alias("col")]


def statistics(value: Column) -> list[Column]:
    return [F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")]


def band_stats(grid: Grid) -> DataFrame:
    """sum, mean, min, max and count of each band, without missing cells."""
    return grid.valid().groupBy("band").agg(*statistics(F.col(grid.value)))


def reduce_all(grid: Grid) -> DataFrame:
    return grid.valid().agg(*statistics(F.col(grid.value)))


def reduce_dim(grid: Grid, dim: str, how: str = "mean") -> DataFrame:
    """Reduce over x, y or band; the other two remain."""
    key = {grid.meta.x_dim: "col", grid.meta.y_dim: "row", grid.meta.extra_dim or "band": "band"}[dim]
    function = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    return grid.valid().groupBy(*[k for k in KEYS if k != key]).agg(function(grid.value).alias(how))


def zonal(grid: Grid, zones: Grid) -> DataFrame:
    """Statistics of cells by the zone of their place."""
    z = zones.valid().select("row", "col", F.col(zones.value).alias("zone"))
    return grid.valid().join(z, ["row", "col"]).groupBy("zone").agg(*statistics(F.col(grid.value)))


def bands_as_columns(grid: Grid, bands=None) -> DataFrame:
    """One row for each place with a column for each band; bands are named, so no pass looks for them."""
    bands = list(bands or grid.meta.bands)
    return grid.df.where(F.col("band").isin(bands)).groupBy("row", "col").pivot("band", bands).agg(F.first(grid.value)).select("row", "col", *[F.col(f"`{b}`").alias(f"band_{b}") for b in bands])


def stack_columns(df: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """The reverse: columns become bands 1, 2, ... in the order of their names."""
    cells = F.array(*[F.struct(F.lit(k).alias("band"), F.col(n).cast("double").alias(value)) for k, n in enumerate(names, 1)])
    return df.select("row", "col", F.inline(cells)).select(*KEYS, value).where(F.col(value).isNotNull())
