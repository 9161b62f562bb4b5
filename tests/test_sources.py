"""Files: round trips, windows, masks and scales; tables and streams."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import errors, operators as op
from gridloom.functions.affine import Affine
from gridloom.functions.crs import parse_crs
from gridloom.plans.grid import Grid, GridSet
from gridloom.plans.meta import GridMeta
from gridloom.sources import asciigrid, raster_sink, raster_source, tables
from gridloom.sources.geotiff import TiffReader, tiff_bytes
from gridloom.streaming.cells import rasterise

ASCII = """ncols 5
nrows 5
xllcorner 440720.000000000000
yllcorner 3750120.000000000000
cellsize 60.000000000000
NODATA_value -99999
 107 123 132 115 132
 115 132 107 123 148
 115 132 140 132 123
 148 132 123 123 115
 132 156 132 140 132
"""


def grid(spark, data, **more):
    data = data[None] if data.ndim == 2 else data
    rows = [(b + 1, r, c, v.item()) for (b, r, c), v in np.ndenumerate(data)]
    kind = {"f8": "double", "f4": "float", "i2": "smallint", "i4": "int"}[data.dtype.str[1:]]
    meta = GridMeta(data.shape[2], data.shape[1], more.pop("transform", Affine(3, 0, 500000, 0, -3, 4600000)), parse_crs(32618), dtype=str(data.dtype), bands=tuple(range(1, len(data) + 1)), **more)
    return Grid(spark.createDataFrame(rows, f"band int, row int, col int, value {kind}"), meta)


def test_ascii_grid(spark, tmp_path):
    data, meta = asciigrid.parse(ASCII)
    assert meta.bounds() == (440720, 3750120, 441020, 3750420) and meta.nodata == -99999 and data[0, 1] == 123
    again, meta2 = asciigrid.parse(asciigrid.render(data, meta))
    assert (again == data).all() and meta2.transform == meta.transform
    g = raster_source.open_raster(spark, ASCII.encode())
    assert g.df.agg(F.sum("value")).first()[0] == data.sum()
    path = tmp_path / "a.asc"
    raster_sink.to_raster(g, str(path))
    assert (raster_sink.to_array(raster_source.open_raster(spark, str(path)))[0] == data).all()


@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(kind, compress):
    data = (np.random.default_rng(0).uniform(0, 100, (3, 50, 37))).astype(kind)
    meta = GridMeta(37, 50, Affine(3, 0, 500000, 0, -3, 4600000), parse_crs(32618), nodata=7)
    r = TiffReader(io.BytesIO(tiff_bytes(data, meta, tile=16, compress=compress, tags={"made": "here"}, scales=[0.1, 1, 1], descriptions=["d1", "d2", "d3"])))
    assert all((r.read(b) == data[b]).all() for b in range(3))
    assert (r.read(1, (13, 35, 5, 30)) == data[1, 13:35, 5:30]).all() and r.read(0, (4, 4, 0, 9)).shape == (0, 9)
    m = r.meta()
    assert m.transform == meta.transform and m.crs.code == "EPSG:32618" and m.nodata == 7
    assert m.attrs["made"] == "here" and m.attrs["scale_factors"] == [0.1, 1.0, 1.0] and m.attrs["long_name"] == ["d1", "d2", "d3"]


def test_sheared_tiff():
    meta = GridMeta(4, 4, Affine(2, 1, 10, 1, -2, 20))
    assert TiffReader(io.BytesIO(tiff_bytes(np.ones((4, 4), "f4"), meta))).transform() == meta.transform
    xc, yc = meta.coords_2d()
    assert (xc[1][2], yc[1][2]) == meta.transform.center(2, 1)


def test_source_reads_only_blocks_it_needs(spark, tmp_path):
    data = np.arange(64 * 96, dtype="f4").reshape(1, 64, 96)
    path = tmp_path / "a.tif"
    path.write_bytes(tiff_bytes(data, GridMeta(96, 64), tile=16))
    reader = raster_source.RasterReader(str(path), None, 2)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    assert len(reader.partitions()) == 4 * 3
    list(reader.pushFilters([GreaterThanOrEqual(("row",), 20), LessThan(("row",), 30), LessThan(("col",), 16)]))
    assert [(p.row, p.cols) for p in reader.partitions()] == [(1, (0, 1))]
    g = raster_source.open_raster(spark, str(path))
    assert g.df.count() == data.size
    part = op.isel(g, row=slice(20, 30), col=slice(3, 14))
    assert (raster_sink.to_array(part)[0] == data[0, 20:30, 3:14]).all()


def test_masked_scaled_unsigned(spark, tmp_path):
    stored = np.array([[0, 1, -1], [-32768, 100, 32767]], "i2")
    path = tmp_path / "s.tif"
    path.write_bytes(tiff_bytes(stored, GridMeta(3, 2, nodata=-1), tile=16, tags={"_Unsigned": "true"}, scales=[0.1], offsets=[220.0]))
    plain = raster_source.open_raster(spark, str(path))
    assert plain.meta.found_nodata() == -1
    masked = raster_source.open_raster(spark, str(path), masked=True)
    assert masked.valid().count() == 5 and masked.meta.encoded_nodata == -1 and math.isnan(masked.meta.found_nodata())
    got = {(r.row, r.col): r.value for r in raster_source.open_raster(spark, str(path), mask_and_scale=True).df.collect()}
    want = {(0, 0): 220.0, (0, 1): 220.1, (0, 2): None, (1, 0): 32768 * 0.1 + 220, (1, 1): 230.0, (1, 2): 32767 * 0.1 + 220}
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())


def test_scaled_round_trip(spark, tmp_path):
    stored = np.array([[10, 20], [-9999, 40]], "i4")
    path = tmp_path / "s.tif"
    path.write_bytes(tiff_bytes(stored, GridMeta(2, 2, nodata=-9999), tile=16, scales=[0.01], offsets=[5.0]))
    g = raster_source.open_raster(spark, str(path), mask_and_scale=True)
    out = tmp_path / "t.tif"
    raster_sink.to_raster(g, str(out))
    r = TiffReader(open(out, "rb"))
    assert r.dtype == np.dtype("i4") and (r.read() == stored).all() and r.meta().attrs["scale_factor"] == 0.01


def test_bands_as_variables_and_dataset(spark, tmp_path):
    data = np.arange(24, dtype="i2").reshape(2, 3, 4)
    path = str(tmp_path / "b.tif")
    raster_sink.to_raster(grid(spark, data), path)
    both = raster_source.open_raster(spark, path, band_as_variable=True)
    assert both.vars == ["band_1", "band_2"] and both.grids["band_2"].df.agg(F.sum("band_2")).first()[0] == data[1].sum()
    assert raster_source.open_dataset(spark, path).vars == ["band_data"]
    assert raster_source.open_dataset(spark, path, band_as_variable=True, drop_variables="band_1").vars == ["band_2"]
    with pytest.raises(ValueError):
        raster_source.open_dataset(spark, path, decode_coords=False)


def test_containers_by_shape(spark, tmp_path):
    paths = {}
    for name, n in (("f:g500/a", 4), ("f:g500/b", 4), ("f:g1000/c", 2)):
        paths[name] = str(tmp_path / f"{name[-1]}.tif")
        raster_sink.to_raster(grid(spark, np.ones((n, n), "f4")), paths[name])
    sets = raster_source.open_variables(spark, paths)
    assert [s.vars for s in sets] == [["a", "b"], ["c"]]
    assert raster_source.open_variables(spark, paths, groups="g1000").vars == ["c"]
    assert raster_source.open_variables(spark, paths, variables=["b"]).vars == ["b"]


def test_dataset_to_bands(spark, tmp_path):
    a = grid(spark, np.ones((3, 3), "f4"), nodata=-1.0)
    path = str(tmp_path / "d.tif")
    raster_sink.to_raster(GridSet({"red": a, "nir": a.map(lambda v: v + 1)}), path)
    r = TiffReader(open(path, "rb"))
    assert r.samples == 2 and r.meta().attrs["long_name"] == ["red", "nir"] and (r.read(1) == 2).all()
    with pytest.raises(errors.RasterError):
        raster_sink.to_raster(GridSet({"a": a, "b": a.with_(nodata=-2.0)}), path)


def test_write_rules(spark, tmp_path):
    g = grid(spark, np.ones((3, 3), "f4"), nodata=-1.1)
    with pytest.raises(OverflowError):
        raster_sink.to_raster(g, str(tmp_path / "x.tif"), dtype="int16")
    with pytest.raises(ValueError):
        raster_sink.to_raster(g, str(tmp_path / "x.nope"))
    later = raster_sink.to_raster(g.with_(nodata=-1.0), str(tmp_path / "later.tif"), dtype="int16", compute=False)
    assert not (tmp_path / "later.tif").exists()
    later()
    assert TiffReader(open(tmp_path / "later.tif", "rb")).dtype == np.dtype("i2")


def test_tile_folder(spark, tmp_path):
    data = np.arange(70 * 50, dtype="f8").reshape(70, 50)
    files = raster_sink.write_tiles(grid(spark, data, nodata=-1.0), str(tmp_path), tile=32)
    assert len(files) == 3 * 2
    parts = [raster_source.open_raster(spark, p) for p in files["path"]]
    whole = op.merge_arrays(parts)
    assert whole.meta.shape == (70, 50) and (raster_sink.to_array(whole)[0] == data).all()


def test_overview_level(spark, tmp_path):
    """A second directory in the file is level 0."""
    from gridloom.sources.tables import overview

    g = grid(spark, np.arange(16, dtype="f8").reshape(4, 4))
    small = overview(g, 0)
    assert small.meta.shape == (2, 2) and small.meta.transform.a == 6
    assert raster_sink.to_array(small)[0].tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_lazy_warp_on_open(spark, tmp_path):
    path = str(tmp_path / "w.tif")
    raster_sink.to_raster(grid(spark, np.ones((6, 6), "f4")), path)
    g = raster_source.open_raster(spark, path, warp={"dst_crs": 4326, "shape": (3, 3)})
    assert g.meta.shape == (3, 3) and g.df.count() == 9


def test_tables(spark, tmp_path):
    g = grid(spark, np.arange(600, dtype="f8").reshape(20, 30), nodata=-1.0, attrs={"a": 1})
    tables.write_cells(g, str(tmp_path / "t"), tile=8)
    back = tables.read_cells(spark, str(tmp_path / "t"))
    assert back.meta == g.meta and back.df.exceptAll(g.df).isEmpty()
    tiles = tables.to_tiles(g, 8)
    assert tiles.count() == 3 * 4 and tables.from_tiles(tiles, g.meta).df.exceptAll(g.df).isEmpty()


def test_unknown_file(spark):
    with pytest.raises(errors.RasterError):
        raster_source.open_raster(spark, b"not a raster")


def test_stream_of_cells(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:30:00", h % 2, h, float(h)) for h in range(8)]
    spark.createDataFrame(rows, "ts string, r int, c int, v double").selectExpr("cast(ts as timestamp) ts", "r", "c", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, r int, c int, v double").parquet(str(tmp_path / "in"))
    out = rasterise(stream, "ts", F.col("r"), F.floor(F.col("c") / 4), F.col("v"))
    q = out.writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.step.hour, r.row, r.col): r.value for r in spark.table("cells").collect()}
    assert got == {(0, 0, 0): 2, (0, 1, 0): 3, (0, 0, 1): 4, (0, 1, 1): 5, (6, 0, 1): 6, (6, 1, 1): 7}


def test_versions(capsys):
    from gridloom.versions import show_versions

    show_versions()
    assert "pyspark" in capsys.readouterr().out


@pytest.mark.parametrize("compress", ["lzw", "packbits", "zstd", "deflate", None])
@pytest.mark.parametrize("kind, predictor", [("u1", 1), ("u1", 2), ("i2", 2), ("u4", 2), ("f4", 2), ("f4", 3), ("f8", 3)])
def test_compressions_and_predictors(kind, predictor, compress):
    rng = np.random.default_rng(5)
    data = np.stack([np.zeros((90, 70)), np.arange(6300).reshape(90, 70) // 5, rng.uniform(0, 250, (90, 70))]).astype(kind)
    meta = GridMeta(70, 90, Affine(3, 0, 500000, 0, -3, 4600000), parse_crs(32618))
    r = TiffReader(io.BytesIO(tiff_bytes(data, meta, tile=64, compress=compress, predictor=predictor)))
    assert all((r.read(b) == data[b]).all() for b in range(3))


def test_lzw_codes():
    # The example of the file format's text, and blocks that fill the table several times.
    from gridloom.sources import blockcodecs as codecs

    def packed(codes, width=9):
        bits = "".join(f"{c:0{width}b}" for c in codes)
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    text, codes = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), [256, 7, 258, 8, 8, 258, 6, 6, 257]
    assert codecs.lzw_decode(packed(codes)) == text and codecs.lzw_encode(text) == packed(codes)
    rng = np.random.default_rng(1)
    for n in (0, 1, 300, 20_000):
        for top in (1, 3, 256):
            data = rng.integers(0, top, n).astype("u1").tobytes()
            assert codecs.lzw_decode(codecs.lzw_encode(data)) == data and codecs.packbits_decode(codecs.packbits_encode(data)) == data
    assert codecs.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    with pytest.raises(ValueError):
        codecs.lzw_decode(b"\0\0\0")


def test_written_compressions(spark, tmp_path):
    data = np.random.default_rng(2).uniform(0, 9, (2, 40, 30)).astype("f4")
    path = str(tmp_path / "z.tif")
    raster_sink.to_raster(grid(spark, data), path, compress="LZW", predictor=3)
    assert (raster_sink.to_array(raster_source.open_raster(spark, path)) == data).all()
    with pytest.raises(ValueError):
        raster_sink.to_raster(grid(spark, data), path, compress="jpeg")
