"""Rasters derived from the tables: dense tiles, summed sales, sparse activity, parts with holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.affine import Affine
from gridloom.functions.crs import parse_crs
from gridloom.plans.grid import Grid
from gridloom.plans.meta import GridMeta


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark, sf_dir) -> Grid:
    """Each embedding of 64 numbers is a band of 8 x 8."""
    cells = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("band"), F.posexplode("embedding").alias("i", "value"))
    df = cells.select("band", F.expr("cast(i div 8 as int)").alias("row"), F.expr("cast(i % 8 as int)").alias("col"), F.col("value").cast("double").alias("value"))
    return Grid(df, GridMeta(8, 8, Affine(0.5, 0, 10, 0, -0.25, 50), parse_crs(4326), "tiles"))


def sales(spark, sf_dir) -> Grid:
    """Cents by return flag (A, N, R), discount (rows) and quantity (columns)."""
    li = _read(spark, sf_dir, "lineitem")
    band = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    cells = li.select(band.alias("band"), F.round(F.col("l_discount") * 100).cast("int").alias("row"), (F.col("l_quantity") - 1).cast("int").alias("col"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    df = cells.groupBy("band", "row", "col").agg(F.sum("cents").alias("value"))
    return Grid(df, GridMeta(50, 11, Affine(30, 0, 500000, 0, -30, 4600000), parse_crs(32615), "sales", "int64", bands=(1, 2, 3)))


#: The kinds of events, by band.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def activity(spark, sf_dir) -> Grid:
    """Greatest value by kind of event, user (rows) and quarter of a day (columns)."""
    ev = _read(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    band = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")).cast("int")
    cells = ev.select(band.alias("band"), (F.col("user_id") % 64).cast("int").alias("row"), F.floor(hours / 6).cast("int").alias("col"), "value")
    df = cells.where("band > 0").groupBy("band", "row", "col").agg(F.max("value").alias("value"))
    return Grid(df, GridMeta(120, 64, Affine(1000, 0, 0, 0, -1000, 64000), parse_crs(3857), "activity", bands=(1, 2, 3, 4, 5)))


def parts(spark, sf_dir) -> Grid:
    """Greatest price in cents by brand (rows) and size (columns); 0 is the missing value."""
    p = _read(spark, sf_dir, "part")
    cells = p.select(F.lit(1).alias("band"), (F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") - 1).alias("row"), (F.col("p_size") - 1).cast("int").alias("col"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    df = cells.groupBy("band", "row", "col").agg(F.max("cents").alias("value"))
    return Grid(df, GridMeta(50, 25, Affine(0.1, 0, -5, 0, -0.1, 50), parse_crs(4326), "parts", "int64", nodata=0))
