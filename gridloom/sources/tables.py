"""Rasters as Parquet: cells or tiles with their meta beside them, and overviews."""

from __future__ import annotations

import dataclasses
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.affine import Affine
from gridloom.functions.crs import parse_crs
from gridloom.plans.grid import KEYS, Grid
from gridloom.plans.meta import GridMeta


def meta_json(meta: GridMeta) -> str:
    d = dataclasses.asdict(meta) | {"crs": meta.crs.code if meta.crs else None, "transform": list(meta.transform)}
    return json.dumps(d, default=str)


def meta_from_json(text: str) -> GridMeta:
    d = json.loads(text)
    d |= {"transform": Affine(*d["transform"]), "crs": parse_crs(d["crs"]) if d["crs"] else None}
    return GridMeta(**{k: tuple(v) if k in ("bands", "band_coords", "gcps") else v for k, v in d.items()})


def write_cells(grid: Grid, path: str, tile: int = 256, mode: str = "errorifexists") -> None:
    """Cells sorted by tile within files, so row and column ranges prune row groups; meta as a one-row text table."""
    key = [F.floor(F.col(c) / tile) for c in ("row", "col")]
    df = grid.df.withColumns({"_tr": key[0], "_tc": key[1]}).repartitionByRange("band", "_tr", "_tc").sortWithinPartitions("band", "_tr", "_tc", "row", "col")
    df.drop("_tr", "_tc").write.mode(mode).parquet(f"{path}/cells")
    grid.df.sparkSession.createDataFrame([(meta_json(grid.meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_cells(spark: SparkSession, path: str) -> Grid:
    meta = meta_from_json(spark.read.text(f"{path}/meta", wholetext=True).first().value)
    return Grid(spark.read.parquet(f"{path}/cells"), meta)


def to_tiles(grid: Grid, tile: int = 256) -> DataFrame:
    """One row for each tile that has a cell: band, tr, tc, row0, col0, h, w, data (float64, NaN where missing)."""
    m, value = grid.meta, grid.value

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        h, w = min(tile, m.height - tr * tile), min(tile, m.width - tc * tile)
        data = np.full((h, w), np.nan)
        data[pdf["row"] - tr * tile, pdf["col"] - tc * tile] = pdf[value]
        return pd.DataFrame({"band": [int(pdf["band"].iloc[0])], "tr": [tr], "tc": [tc], "row0": [tr * tile], "col0": [tc * tile], "h": [h], "w": [w], "data": [data.tobytes()]})

    cells = grid.valid().withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int"), value: F.col(value).cast("double")})
    return cells.groupBy("band", "tr", "tc").applyInPandas(pack, "band int, tr int, tc int, row0 int, col0 int, h int, w int, data binary")


def from_tiles(tiles: DataFrame, meta: GridMeta, value: str = "value") -> Grid:
    def unpack(batches):
        for pdf in batches:
            for t in pdf.itertuples():
                data = np.frombuffer(t.data).reshape(t.h, t.w)
                r, c = np.nonzero(~np.isnan(data))
                yield pd.DataFrame({"band": t.band, "row": (r + t.row0).astype("int32"), "col": (c + t.col0).astype("int32"), value: data[r, c]})

    return Grid(tiles.mapInPandas(unpack, f"band int, row int, col int, {value} double"), meta)


def overview(grid: Grid, level: int) -> Grid:
    """A pyramid level: level 0 averages blocks of two by two, each further one doubles them."""
    k = 2 ** (level + 1)
    m = grid.meta
    small = grid.valid().groupBy("band", F.expr(f"cast(row div {k} as int)").alias("row"), F.expr(f"cast(col div {k} as int)").alias("col")).agg(F.avg(grid.value).alias(grid.value))
    t = m.transform
    return Grid(small.select(*KEYS, grid.value), m.with_(width=math.ceil(m.width / k), height=math.ceil(m.height / k), transform=t._replace(a=t.a * k, b=t.b * k, d=t.d * k, e=t.e * k)))
