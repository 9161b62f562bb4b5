"""Driver-side geometry, systems, conventions, tags and options against literal values."""

import datetime
import math
import re

import numpy as np
import pytest

from gridloom import errors, options
from gridloom.functions import crs
from gridloom.functions.affine import IDENTITY, Affine, Bounds, Window, snap
from gridloom.plans import conventions as conv
from gridloom.plans.meta import GridMeta, default_nodata, exact_nodata
from gridloom.sources import tags
from gridloom.operators.warp import default_grid, fit_gcps, resampling_name


def test_bounds_of_unit_cells():
    assert GridMeta(5, 5, Affine(1, 0, -0.5, 0, 1, -0.5)).bounds() == (-0.5, -0.5, 4.5, 4.5)


def test_geotransform_text_round_trip():
    t = Affine(3, 0, 425047, 0, -3, 4615780)
    assert t.geotransform() == "425047.0 3.0 0.0 4615780.0 0.0 -3.0"
    assert Affine.from_gdal(*map(float, t.geotransform().split())) == t


def test_rotated_transform_stays():
    t = Affine(14, 9, 305827, 9, -14, 5223236)
    assert t.rotated and GridMeta(3, 3, t).recalculated_transform() == t
    assert Affine(0, -10, 5, -10, 0, 5).resolution == (10, 10)


def test_no_georeference():
    m = GridMeta(4, 3)
    assert m.transform == IDENTITY
    assert m.y_coords() == [0.5, 1.5, 2.5] and m.x_coords() == [0.5, 1.5, 2.5, 3.5]


def test_window_rounding_and_clamping():
    assert snap(Window(-1.5, 2.2, 0.9, 99), 10, 5) == Window(0, 3, 0, 10)
    assert snap(Window(-3, -1, 2, 4), 10, 5)[:2] == (0, 0)
    with pytest.raises(ValueError):
        IDENTITY.window((3, 0, 1, 1))


def test_sheared_inverse():
    t = Affine(2, 0.5, 10, -0.25, -3, 7)
    assert np.allclose(t.inverse()(*t(3.25, 4.5)), (3.25, 4.5))


@pytest.mark.parametrize("dims, error", [(("a", "b", "y", "x"), errors.TooManyDimensions), (("x", "y"), errors.DimensionOrder), (("y", "band", "x"), errors.DimensionOrder)])
def test_dimension_checks(dims, error):
    with pytest.raises(error):
        GridMeta.of_dims(dims, dict.fromkeys(dims, 2))


def test_lonlat_box_in_sinusoidal():
    """A box in degrees, widened to whole cells, as the reference grid has it."""
    t = Affine(231.6563582639536, 0, -7274009.649486291, 0, -231.65635826374404, 5050108.61015275)
    box = crs.transform_bounds(4326, "sinusoidal", (-93.1558, 45.403, -93.1557, 45.4065))
    w = snap(t.window(box), 200, 200)
    got = t.shifted(w.col_start, w.row_start).bounds(w.col_stop - w.col_start, w.row_stop - w.row_start)
    assert np.allclose(got, (-7272851.367694971, 5048487.015644904, -7272156.398620179, 5049181.9847196955), atol=1e-6)


def test_sinusoidal_bounds_in_mercator():
    m = GridMeta(200, 200, Affine(231.6563582639536, 0, -7274009.649486291, 0, -231.65635826374404, 5050108.61015275), crs.parse_crs("sinusoidal"))
    got = m.transform_bounds(3395, 100)
    assert np.allclose(got, (-10374232.525903117, 5591295.917919335, -10232919.684719983, 5656912.314724255), atol=1e-3)


@pytest.mark.parametrize("value, code", [(4326, "EPSG:4326"), ("epsg:32615", "EPSG:32615"), ("+proj=utm +zone=15 +datum=WGS84 +units=m", "EPSG:32615"), ("+proj=utm +zone=15 +south +datum=WGS72", "EPSG:32315"), ("+init=epsg:3857", "EPSG:3857"), ({"id": {"authority": "EPSG", "code": 26915}}, "EPSG:26915"), ('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32733"]]', "EPSG:32733"), ("+proj=sinu +R=6371007.181", "SINUSOIDAL")])
def test_crs_inputs(value, code):
    assert crs.parse_crs(value).code == code


def test_crs_objects_and_errors():
    class Holder:
        wkt = 'GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]'

    assert crs.parse_crs(Holder()).geographic
    with pytest.raises(errors.MissingCrs):
        crs.parse_crs(None)
    with pytest.raises(ValueError):
        crs.parse_crs(27700)


@pytest.mark.parametrize("code", [3857, 3395, 32615, 32733, 32215, "sinusoidal"])
def test_projection_round_trip(code):
    c = crs.parse_crs(code)
    lon0 = 6 * c.zone - 183 if c.zone else 10
    lon, lat = np.array([lon0 - 2.5, lon0 + 1.0]), np.array([-33.0, 61.0])
    back = crs.to_lonlat(c, *crs.from_lonlat(c, lon, lat))
    assert np.allclose(back, (lon, lat), atol=1e-9)


def test_utm_zones():
    box = lambda x, y: Bounds(x - 0.1, y - 0.1, x + 0.1, y + 0.1)
    assert crs.utm_crs_of(crs.parse_crs(4326), box(-93.2, 44)).code == "EPSG:32615"
    assert crs.utm_crs_of(crs.parse_crs(4326), box(15.2, -33)).code == "EPSG:32733"
    assert crs.utm_crs_of(crs.parse_crs(4326), box(-93.2, 44), "WGS 72").code == "EPSG:32215"
    assert crs.utm_crs_of(crs.parse_crs(4326), box(5, 60)).code == "EPSG:32632"
    with pytest.raises(errors.MissingCrs):
        crs.utm_crs_of(None, box(0, 0))
    with pytest.raises(RuntimeError):
        crs.utm_crs_of(crs.parse_crs(4326), box(0, 88))


def test_default_grid_shape():
    m = GridMeta(6, 6, Affine(7.8, 0, 425489.28381405, 0, -43.8, 4615536.44054639), crs.parse_crs(26915))
    _, width, height = default_grid(m, 4326)
    assert (height, width) == (8, 2)


def test_gcp_grid():
    """The transform, cell size and shape that four points give."""
    corners = [(0, 0, 156113, 2818720), (0, 800, 338353, 2785790), (800, 800, 297939, 2618518), (800, 0, 115698, 2651448)]
    gcps = tuple(dict(row=r, col=c, x=x, y=y) for r, c, x, y in corners)
    m = GridMeta(800, 800, crs=crs.parse_crs(32618), gcps=gcps)
    t, width, height = default_grid(m, 32618)
    assert (height, width) == (923, 1027)
    assert np.allclose((t.a, t.e, t.f), (216.8587081056465, -216.8587081056465, 2818720.0), rtol=1e-6)


def test_resampling_names():
    assert resampling_name("Bilinear") == "bilinear"
    with pytest.raises(ValueError):
        resampling_name("splat")


@pytest.mark.parametrize("dtype, value", [("uint8", 255), ("uint16", 65535), ("uint32", 4294967295), ("int8", -128), ("int16", -32768), ("int32", -2147483648), ("int64", -(2**63)), ("complex_int16", None)])
def test_default_missing_values(dtype, value):
    assert default_nodata(dtype) == value


def test_missing_value_rules():
    assert math.isnan(default_nodata("float32"))
    for value, dtype in ((-1.1, "int32"), (-1, "uint8"), (256, "uint8"), (math.nan, "int16")):
        with pytest.raises(OverflowError):
            exact_nodata(value, dtype)
    m = GridMeta(2, 2, dtype="int16", attrs={"missing_value": -9})
    assert m.found_nodata() == -9 and m.set_nodata(5).found_nodata() == 5
    e = m.write_nodata(-1, encoded=True)
    assert e.encoded_nodata == -1 and math.isnan(e.found_nodata()) and e.encoding["_FillValue"] == -1
    assert m.write_nodata(None).found_nodata() is None


def test_options():
    with options.set_options(convention="zarr"):
        assert options.get_option("convention") == "zarr"
    assert options.get_option("convention") is None
    for bad in ({"no_such": 1}, {"convention": "other"}, {"export_grid_mapping": 3}):
        with pytest.raises(ValueError):
            options.set_options(**bad)


def test_cf_round_trip():
    d = conv.write_transform(conv.write_crs(conv.Described(dims=("y", "x")), 32615), Affine(3, 0, 5, 0, -3, 9))
    assert conv.read_crs(d).code == "EPSG:32615" and conv.read_transform(d) == Affine(3, 0, 5, 0, -3, 9) and conv.read_dims(d) == ("x", "y")
    assert d.coords["spatial_ref"]["GeoTransform"] == "5.0 3.0 0.0 9.0 0.0 -3.0" and d.encoding["grid_mapping"] == "spatial_ref"
    with options.set_options(export_grid_mapping=False):
        assert "grid_mapping_name" not in conv.write_crs(conv.Described(), 32615).coords["spatial_ref"]


def test_zarr_round_trip_needs_declaration():
    d = conv.write_crs(conv.Described(dims=("y", "x")), 4326, "zarr")
    d = conv.write_transform(d, Affine(1, 0, 0, 0, -1, 20), "zarr", shape=(20, 10), dims=("y", "x"))
    assert conv.declared(d.attrs) == {"proj", "spatial"} and d.attrs["spatial:bbox"] == [0, 0, 10, 20]
    assert conv.read_crs(d).code == "EPSG:4326" and conv.read_transform(d) == Affine(1, 0, 0, 0, -1, 20) and conv.read_dims(d) == ("x", "y")
    bare = conv.Described({k: v for k, v in d.attrs.items() if k != "zarr_conventions"}, dims=("lat", "lon"))
    assert conv.read_crs(bare) is None and conv.read_transform(bare) is None
    with pytest.raises(errors.MissingSpatialDimension):
        conv.read_dims(bare)


def test_convention_order():
    both = conv.write_crs(conv.write_crs(conv.Described(), 4326, "zarr"), 3857, "cf")
    assert conv.read_crs(both).code == "EPSG:3857"
    with options.set_options(convention="zarr"):
        assert conv.read_crs(both).code == "EPSG:4326"
    assert conv.read_crs(conv.Described({"crs": "EPSG:3395"})).code == "EPSG:3395"


def test_dims_by_attributes():
    d = conv.Described(coords={"rlat": {"axis": "Y"}, "rlon": {"standard_name": "longitude"}}, dims=("rlat", "rlon"))
    assert conv.read_dims(d) == ("rlon", "rlat")
    assert conv.read_dims(conv.Described(dims=("latitude", "longitude"))) == ("longitude", "latitude")


def test_coordinate_attributes():
    assert conv.coordinate_attrs(crs.parse_crs(4326), "y") == {"axis": "Y", "long_name": "latitude", "standard_name": "latitude", "units": "degrees_north"}
    assert conv.coordinate_attrs(crs.parse_crs(32615), "x")["units"] == "metre"
    assert conv.coordinate_attrs(crs.parse_crs(32615), "x", 0.3048)["units"] == "0.3048 metre"
    assert conv.coordinate_attrs(None, "x") == {"axis": "X"}


def test_gcps_and_rpcs():
    gcps = [{"id": "a", "info": "", "row": 0, "col": 800, "x": 1.5, "y": 2.5, "z": 3.0}, {"id": "b", "info": "", "row": 1, "col": 2, "x": 0.0, "y": 0.0}]
    assert conv.gcps_from_geojson(conv.gcps_to_geojson(gcps)) == gcps
    assert conv.rpcs_from_json(conv.rpcs_to_json({"a": [1.0]})) == {"a": [1.0]}
    assert GridMeta(2, 2).write_rpcs({"a": 1}).crs.code == "EPSG:4326"


def test_tags():
    assert tags.parse_tag("NC_GLOBAL#history", "{1,2.5}") == ("history", [1.0, 2.5])
    assert tags.parse_tags({"a": "3", "b": "3.5", "c": "x"}) == {"a": 3, "b": 3.5, "c": "x"}
    assert tags.extra_dimensions({"NETCDF_DIM_EXTRA": "{time}", "NETCDF_DIM_time_VALUES": "{0,872712.659688}"}) == {"time": [0.0, 872712.659688]}
    assert tags.variable_tags({"time#units": "s", "x#a": "1"}, "time") == {"units": "s"}
    coords, attrs = tags.band_vectors({"wavelength": "{1,2,3}", "sensor": "s"}, 3)
    assert coords == {"wavelength": [1.0, 2.0, 3.0]} and attrs == {"sensor": "s"}
    with pytest.warns(UserWarning):
        assert tags.raster_attrs({}, scales=(1.0, 2.0))["scale_factors"] == [1.0, 2.0]


def test_times():
    got = tags.decode_times([0, 872712.659688], "seconds since 2016-12-19T10:27:29.687763")
    assert got[0] == datetime.datetime(2016, 12, 19, 10, 27, 29, 687763) and got[1] - got[0] == datetime.timedelta(seconds=872712.659688)
    assert tags.decode_times([2], "days") == [datetime.timedelta(days=2)]
    assert tags.decode_times([2], "days", decode_timedelta=False) == [2] and tags.decode_times([2], "days since 2000-01-01", False) == [2]


@pytest.mark.parametrize("uri, groups, variables, found", [("netcdf:a.nc:grid/temp", None, "temp", True), ("netcdf:a.nc:grid/temp2", None, "temp", False), ("netcdf:a.nc:/grid/temp", "grid", None, True), ("netcdf:a.nc:/other/temp", "grid", None, False), ("netcdf:a.nc:/grid/temp", ["grid"], ["temp", "wet"], True), ("netcdf:a.nc:/grid/sub/wet", ["grid"], ["temp", "wet"], True), ("netcdf:a.nc:/x/wet", ["grid"], ["wet"], False), ("anything", None, None, True)])
def test_variable_pattern(uri, groups, variables, found):
    assert bool(re.search(tags.variable_pattern(groups, variables), uri)) is found


def test_raster_endings():
    assert tags.looks_like_raster("a/B.TIF") and tags.looks_like_raster("x.asc") and not tags.looks_like_raster("x.nc")


def test_metadata_helpers():
    from gridloom.functions.affine import affine_to_coords

    m = GridMeta(2, 2, Affine(2, 0, 0, 0, -2, 4), crs.parse_crs(4326))
    assert affine_to_coords(m.transform, 2, 2) == {"x": [1, 3], "y": [3, 1]}
    assert set(affine_to_coords(Affine(1, 1, 0, 1, -1, 0), 2, 2)) == {"xc", "yc"}
    assert m.coordinate_system()["y"]["units"] == "degrees_north"
    with pytest.warns(DeprecationWarning):
        assert m.set_crs(3857).crs.code == "EPSG:3857"
    assert m.update_attrs({"a": 1}).set_attrs({"b": 2}).attrs == {"b": 2}
    assert m.update_encoding({"_FillValue": 3}).encoded_nodata == 3 and m.write_transform(Affine(1, 0, 0, 0, -1, 2), "crs").grid_mapping == "crs"
