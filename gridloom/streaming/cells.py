"""Rasters from streams: events become cells of time steps as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rasterise(stream: DataFrame, time: str, row: Column, col: Column, value: Column, step: str = "6 hours", late: str = "1 hour", how: str = "max") -> DataFrame:
    """Cells (step start, row, col, value) of a stream of events; a step is final once the watermark has passed it."""
    function = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "count": F.count}[how]
    cells = stream.withWatermark(time, late).select(F.window(time, step).alias("w"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("value"))
    return cells.groupBy("w", "row", "col").agg(function("value").alias("value")).select(F.col("w.start").alias("step"), "row", "col", "value")
