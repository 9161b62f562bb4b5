"""Raster operations on small grids, against plain numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom import errors, operators as op, options
from gridloom.functions.affine import Affine, Window
from gridloom.functions.crs import parse_crs
from gridloom.operators.warp import densify, target_cells
from gridloom.plans.grid import Grid, GridSet
from gridloom.plans.meta import GridMeta
from gridloom.sources.raster_sink import to_array


def make(spark, data, transform=None, crs=26915, **more):
    data = np.asarray(data, float)
    data = data[None] if data.ndim == 2 else data
    rows = [(b + 1, r, c, None if math.isnan(v) else float(v)) for b, layer in enumerate(data) for r, line in enumerate(layer) for c, v in enumerate(line)]
    meta = GridMeta(data.shape[2], data.shape[1], transform or Affine(1, 0, 0, 0, -1, data.shape[1]), parse_crs(crs) if crs else None, bands=tuple(range(1, len(data) + 1)), **more)
    return Grid(spark.createDataFrame(rows, "band int, row int, col int, value double"), meta)


def dense(grid):
    return to_array(grid.with_(nodata=math.nan))


@pytest.fixture(scope="module")
def six(spark):
    """Six layers of 6 x 6 in UTM, cells of 7.8 by 43.8 metres."""
    t = Affine(7.8, 0, 425493.18381405 - 3.9, 0, -43.8, 4615514.54054639 + 21.9)
    return make(spark, np.arange(216.0).reshape(6, 6, 6), t)


def test_clip_box_shape(six):
    g = op.clip_box(six, 425500.18381405, 4615395.54054639, 425520.18381405, 4615414.54054639, allow_one_dimensional_raster=True)
    assert (g.meta.count, *g.meta.shape) == (6, 2, 3)
    assert g.df.count() == 36


def test_clip_box_errors_and_expand(six):
    with pytest.raises(errors.NoCellsInBounds):
        op.clip_box(six, 0, 0, 1, 1)
    x, y = six.meta.transform.center(2, 2)
    with pytest.raises(errors.OneCellWide):
        op.clip_box(six, x - 1, y - 1, x + 1, y + 1)
    assert op.clip_box(six, x - 1, y - 1, x + 1, y + 1, allow_one_dimensional_raster=True).meta.shape == (1, 1)
    assert op.clip_box(six, x - 1, y - 1, x + 1, y + 1, auto_expand=True).meta.shape == (3, 3)
    with pytest.raises(ValueError):
        op.clip_box(six, 5, 0, 1, 1)


def test_default_reprojection_shape(six):
    g = op.reproject(six, 4326)
    assert g.meta.shape == (8, 2) and g.meta.crs.code == "EPSG:4326" and (g.meta.x_dim, g.meta.y_dim) == ("x", "y")


def test_polygon_clip_shape(spark):
    g = make(spark, np.arange(36.0).reshape(6, 6), nodata=-1.0)
    tri = {"type": "Polygon", "coordinates": [[(1.2, 1.2), (4.9, 1.2), (4.9, 4.9), (1.2, 4.9), (1.2, 1.2)]]}
    out = op.clip(g, [tri])
    assert out.meta.shape == (4, 4) and out.df.count() == 16
    assert op.clip(g, [tri], all_touched=True).meta.shape == (4, 4)
    inv = dense(op.clip(g, [tri], invert=True, drop=False).with_(nodata=None))
    assert (inv[0, 1:5, 1:5] == -1).all() and (inv[0, 0] == np.arange(6)).all()
    with pytest.raises(errors.NoCellsInBounds):
        op.clip(g, [{"type": "Polygon", "coordinates": [[(50, 50), (51, 50), (51, 51), (50, 50)]]}])


def test_clip_geometry_in_other_system(six):
    from gridloom.functions.crs import to_lonlat

    x0, y0, x1, y1 = 425496, 4615340, 425520, 4615450
    ring = [tuple(map(float, to_lonlat(six.meta.crs, x, y))) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    a, b = op.clip(six, [{"type": "Polygon", "coordinates": [ring]}], 4326), op.clip(six, [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]])
    assert a.meta.shape == b.meta.shape and a.df.exceptAll(b.df).isEmpty()


def test_array_form_of_polygons_agrees(spark):
    from gridloom.functions import geometry as geo

    g = make(spark, np.ones((40, 40)))
    ring = [(20 + 15.3 * math.cos(k / 60 * 2 * math.pi), 20 + 11.7 * math.sin(k / 60 * 2 * math.pi)) for k in range(60)]
    many = [p for a, b in zip(ring, ring[1:] + ring[:1]) for p in (a, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2))]
    assert len(geo.edges([ring])) <= geo.UNROLLED < len(geo.edges([many]))
    for touched in (False, True):
        a, b = (op.clip(g, [{"type": "Polygon", "coordinates": [r]}], all_touched=touched) for r in (ring, many))
        assert a.meta.shape == b.meta.shape and a.df.exceptAll(b.df).isEmpty() and b.df.exceptAll(a.df).isEmpty()


def test_clip_then_pad_is_whole(spark):
    data = np.arange(100.0).reshape(10, 10)
    g = make(spark, data, nodata=-1.0)
    part = op.clip_box(g, 4.1, 3.2, 6.9, 5.8)
    back = op.pad_box(part, 0.5, 0.5, 9.5, 9.5)
    assert back.meta.shape == (10, 10) and np.allclose(back.meta.transform, g.meta.transform)
    again = op.clip_box(back, 4.1, 3.2, 6.9, 5.8)
    assert again.df.exceptAll(part.df).isEmpty() and again.meta.shape == part.meta.shape
    assert back.df.where("row = 0 and col = 0").first().value == -1


def test_pad_south_up(spark):
    g = make(spark, [[1.0, 2], [3, 4]], Affine(1, 0, 0, 0, 1, 0), nodata=0.0)
    out = op.pad_xy(g, -1.6, -0.2, 2.4, 3.6)
    assert out.meta.shape == (4, 4) and out.meta.transform == Affine(1, 0, -2, 0, 1, 0)
    assert dense(out)[0].tolist() == [[0, 0, 1, 2], [0, 0, 3, 4], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_pad_constants(spark):
    g = make(spark, [[1.0, 2], [3, 4]])
    out = dense(op.pad_xy(g, -0.6, -0.6, 2.6, 2.6, constant_values=((7, 8), (9, 9))))[0]
    assert out.tolist() == [[9, 7, 7, 9], [9, 1, 2, 9], [9, 3, 4, 9], [9, 8, 8, 9]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 4), st.integers(0, 4), st.integers(1, 5), st.integers(1, 5), st.integers(0, 2), st.integers(0, 2))
def test_windows_compose(spark, r, c, h, w, r2, c2):
    g = make(spark, np.arange(64.0).reshape(8, 8))
    one = op.isel_window(op.isel_window(g, Window(r, r + h, c, c + w)), Window(r2, h, c2, w))
    two = op.isel_window(g, Window(r + min(r2, h), r + h, c + min(c2, w), c + w))
    assert one.meta.shape == two.meta.shape and one.meta.transform == two.meta.transform and one.df.exceptAll(two.df).isEmpty()


def test_indexing(spark):
    data = np.arange(24.0).reshape(2, 3, 4)
    g = make(spark, data)
    cases = [dict(row=slice(None, None, -1)), dict(col=slice(1, None, 2)), dict(row=[2, 0, 2], col=[3, 1]), dict(band=1), dict(band=[0], row=1), dict(col=-1), dict(row=slice(2, 2))]
    for case in cases:
        key = [case.get(k, slice(None)) for k in ("band", "row", "col")]
        key = [[k] if isinstance(k, int) else k for k in key]
        want = data[key[0]][:, key[1]][:, :, key[2]]
        got = op.isel(g, **case)
        assert (got.meta.count, *got.meta.shape) == want.shape
        if want.size:
            assert (dense(got) == want).all(), case


def test_index_coordinates(spark):
    g = make(spark, np.arange(24.0).reshape(4, 6))
    out = op.isel(g, row=slice(None, None, -2), col=slice(1, None, 3))
    assert out.meta.y_coords() == [0.5, 2.5] and out.meta.x_coords() == [1.5, 4.5]


def test_slice_includes_ends(spark):
    g = make(spark, np.arange(16.0).reshape(4, 4))
    out = op.slice_xy(g, 0.5, 1.5, 2.5, 3.5)
    assert out.meta.shape == (3, 3) and dense(out)[0, 0, 0] == 0
    up = make(spark, np.arange(16.0).reshape(4, 4), Affine(-1, 0, 4, 0, 1, 0))
    assert op.slice_xy(up, 0.5, 1.5, 2.5, 3.5).meta.shape == (3, 3)


def test_reproject_to_itself(spark):
    data = np.random.default_rng(0).uniform(0, 1, (2, 7, 5))
    g = make(spark, data)
    for method in ("nearest", "bilinear", "cubic", "average", "min"):
        out = op.reproject_match(g, g, resampling=method)
        assert out.meta.shape == g.meta.shape and np.allclose(dense(out), data), method


def _parts(edges, n):
    """How much of each of n cells lies between neighbouring edges."""
    lo, hi = np.minimum(edges[:-1], edges[1:])[:, None], np.maximum(edges[:-1], edges[1:])[:, None]
    return np.clip(np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n)), 0, None)


def test_area_methods_weigh_by_what_is_covered(spark):
    data = np.random.default_rng(4).uniform(1, 9, (2, 6, 5)).round(0)
    data[0, 2, 3] = math.nan
    g = make(spark, data, Affine(2, 0, 0, 0, -2, 12))
    for to, shape in ((Affine(0.7, 0, -1, 0, -0.9, 13), (16, 17)), (Affine(3.1, 0, 0.3, 0, -5, 12), (3, 3)), (Affine(2, 0, 1, 0, 2, 1), (6, 6))):
        rows, cols = _parts((12 - (to.f + to.e * np.arange(shape[0] + 1))) / 2, 6), _parts((to.c + to.a * np.arange(shape[1] + 1)) / 2, 5)
        for method in ("average", "sum", "rms", "mode", "max", "med") if to.a == 3.1 else ("average", "mode"):
            got = dense(op.reproject(g, 26915, transform=to, shape=shape, resampling=method))
            for b in range(2):
                for r in range(shape[0]):
                    for c in range(shape[1]):
                        w = np.outer(rows[r], cols[c])
                        w[np.isnan(data[b])] = 0
                        v, w = data[b][w > 1e-9], w[w > 1e-9]
                        if not len(v):
                            assert math.isnan(got[b, r, c]), (method, b, r, c)
                            continue
                        values = np.unique(v)
                        want = {
                            "average": (v * w).sum() / w.sum(), "sum": (v * w).sum(), "rms": math.sqrt((v * v * w).sum() / w.sum()), "max": v.max(), "med": np.median(v),
                            "mode": values[np.argmax([w[v == x].sum().round(9) for x in values])],
                        }[method]
                        assert got[b, r, c] == pytest.approx(want, abs=1e-9), (method, b, r, c)


def test_area_methods_by_boxes_of_targets(spark, monkeypatch):
    from gridloom.operators import warp

    data = np.random.default_rng(5).uniform(0, 1, (9, 8))
    g = make(spark, data, Affine(0.5, 0, 10, 0, -0.25, 50), 4326)
    want = {m: dense(op.reproject(g, 3857, shape=(5, 3), resampling=m)) for m in ("average", "sum")}
    monkeypatch.setattr(warp, "_APART", set())
    for m, w in want.items():
        assert np.allclose(dense(op.reproject(g, 3857, shape=(5, 3), resampling=m)), w, atol=1e-9, equal_nan=True), m
    constant = op.reproject(make(spark, np.full((9, 8), 7.0), g.meta.transform, 4326), 32633, resampling="average")
    assert constant.df.count() > 50 and {round(r.value, 9) for r in constant.df.collect()} == {7.0}


def test_area_methods_at_a_pole_and_without_cells(spark):
    whole = make(spark, np.ones((4, 4)), Affine(90, 0, -180, 0, -45, 90), 4326)
    assert op.reproject(whole, 3857, transform=Affine(1e7, 0, -2e7, 0, -1e7, 2e7), shape=(4, 4), resampling="average").df.count() == 16
    empty = whole.with_(whole.df.limit(0))
    assert op.reproject(empty, 3857, transform=Affine(1e7, 0, -2e7, 0, -1e7, 2e7), shape=(4, 4), resampling="sum").df.count() == 0


def test_reproject_rotated(spark):
    data = np.arange(100.0).reshape(10, 10) + 1
    g = make(spark, data, Affine(1, 0.2, 0, 0, 1, 0), nodata=0.0)
    flat = op.reproject(g, 26915, transform=Affine(1, 0, 0, 0, 1, 0), shape=(10, 12))
    got = {(r.row, r.col): r.value for r in flat.df.collect()}
    for r in range(10):
        for c in range(12):
            u = c + 0.5 - 0.2 * (r + 0.5)
            want = data[r, math.floor(u)] if 0 <= u < 10 else None
            assert got.get((r, c)) == want


def test_reproject_arguments(six):
    with pytest.raises(ValueError):
        op.reproject(six, 4326, resolution=1, shape=(2, 2))
    with pytest.raises(errors.MissingCrs):
        op.reproject(six.with_(crs=None), 4326)
    same = op.reproject(six, 4326, transform=Affine(1e-4, 0, -93.9, 0, -1e-4, 41.7))
    assert same.meta.shape == six.meta.shape
    assert op.reproject(six, 4326, shape=(3, 4)).meta.shape == (3, 4)


def test_missing_value_of_target(six):
    assert math.isnan(op.reproject(six, 4326).meta.nodata)
    assert op.reproject(six, 4326, nodata=-5.0).meta.nodata == -5
    filled = densify(op.reproject(six, 4326, nodata=-5.0))
    assert filled.df.count() == 6 * 8 * 2


def test_gcps_rpcs_and_places(spark):
    data = np.arange(16.0).reshape(4, 4)
    g = make(spark, data, Affine(), crs=32618)
    gcps = tuple(dict(row=r, col=c, x=500000 + 10 * c, y=4000000 - 10 * r) for r, c in ((0, 0), (0, 4), (4, 4), (4, 0)))
    by_points = op.reproject(g, 32618, gcps=gcps)
    assert by_points.meta.shape == (4, 4) and np.allclose(dense(by_points)[0], data)
    # A plain linear model written as rational polynomials.
    one = [1.0] + [0.0] * 19
    rpcs = {"line_off": 1.5, "line_scale": 2, "samp_off": 1.5, "samp_scale": 2, "lat_off": 50, "lat_scale": 2, "long_off": 10, "long_scale": 2, "height_off": 0, "height_scale": 1, "line_num_coeff": [0, 0, -1.0] + [0] * 17, "line_den_coeff": one, "samp_num_coeff": [0, 1.0] + [0] * 18, "samp_den_coeff": one}
    by_model = op.reproject(g, 4326, rpcs=rpcs, transform=Affine(1, 0, 8, 0, -1, 52), shape=(4, 4))
    assert np.allclose(dense(by_model)[0], data)
    places = target_cells(spark, Affine(), 4, 4).selectExpr("row", "col", "500000d + 10 * (col + 0.5d) as x", "4000000d - 10 * (row + 0.5d) as y")
    by_places = op.reproject(g, 32618, src_geoloc_array=places, transform=Affine(10, 0, 500000, 0, -10, 4000000), shape=(4, 4))
    assert np.allclose(dense(by_places)[0], data)


def _quadrants(spark):
    data = np.arange(400 * 1.0).reshape(20, 20)
    t = Affine(231.656, 0, -7274009.6, 0, -231.656, 5050108.6)
    g = make(spark, data, t, crs="sinusoidal", nodata=-28672.0)
    return data, g, [op.isel_window(g, Window(r, r + 10, c, c + 10)) for r in (0, 10) for c in (0, 10)]


def test_merge_quadrants(spark):
    data, g, parts = _quadrants(spark)
    out = op.merge_arrays(parts)
    assert out.meta.shape == (20, 20) and np.allclose(out.meta.transform, g.meta.transform) and np.allclose(dense(out)[0], data)
    assert out.meta.nodata == -28672
    assert op.merge_arrays(parts, res=300).meta.shape == (16, 16)


@pytest.mark.parametrize("method", ["min", "max", "sum", "count"])
def test_merge_order_does_not_matter(spark, method):
    _, _, parts = _quadrants(spark)
    parts.append(op.isel_window(op.merge_arrays(parts), Window(5, 15, 5, 15)))
    a, b = op.merge_arrays(parts, method=method), op.merge_arrays(parts[::-1], method=method)
    assert a.df.exceptAll(b.df).isEmpty()


def test_merge_skips_missing_and_warps(spark):
    a = make(spark, [[1.0, -1], [-1, 4]], nodata=-1.0)
    b = make(spark, [[9.0, 2], [3, -1]], nodata=-1.0)
    assert dense(op.merge_arrays([a, b])).tolist() == [[[1, 2], [3, 4]]]
    fine = make(spark, np.ones((4, 4)), Affine(0.5, 0, 0, 0, -0.5, 2), nodata=-1.0)
    assert op.merge_arrays([a, fine]).meta.shape == (2, 2)
    with pytest.raises(ValueError):
        op.merge_arrays([a], method="blend")


def test_gap_filling_against_brute_force(spark):
    rng = np.random.default_rng(4)
    data = rng.uniform(0, 9, (1, 30, 40))
    data[rng.uniform(size=data.shape) < 0.97] = np.nan
    g = make(spark, data, Affine(2, 0, 0, 0, -1, 30), nodata=math.nan)
    got = dense(op.interpolate_na(g))[0]
    r, c = np.nonzero(~np.isnan(data[0]))
    for i in range(30):
        for j in range(40):
            d = ((c - j) * 2.0) ** 2 + (r - i) ** 2
            k = np.lexsort((c, r, d))[0]
            assert got[i, j] == data[0, r[k], c[k]]


def test_gap_filling_rules(spark):
    g = make(spark, [[1.0, np.nan, 3], [np.nan, np.nan, np.nan], [7, np.nan, 9]])
    with pytest.raises(errors.RasterError):
        op.interpolate_na(g)
    plane = g.with_(nodata=math.nan)
    for method in ("linear", "cubic"):
        assert np.allclose(dense(op.interpolate_na(plane, method))[0], [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    empty = make(spark, np.full((2, 2), np.nan), nodata=math.nan)
    assert op.interpolate_na(empty).valid().isEmpty()


def test_linear_stays_within_its_corners(spark):
    rng = np.random.default_rng(2)
    data = rng.uniform(0, 1, (12, 12))
    data[rng.uniform(size=data.shape) < 0.6] = np.nan
    out = dense(op.interpolate_na(make(spark, data, nodata=math.nan), "linear"))[0]
    known = data[~np.isnan(data)]
    assert np.nanmin(out) >= known.min() - 1e-9 and np.nanmax(out) <= known.max() + 1e-9


def test_algebra_and_statistics(spark):
    a, b = make(spark, [[1.0, 2], [np.nan, 4]]), make(spark, [[10.0, np.nan], [30, 40]])
    got = {(r.row, r.col): r.value for r in op.align(a, b, lambda x, y: x + y).df.collect()}
    assert got == {(0, 0): 11, (1, 1): 44}
    s = op.band_stats(a).first()
    assert (s["sum"], s["count"], s["min"], s["max"]) == (7, 3, 1, 4)
    assert {r.row: r["mean"] for r in op.reduce_dim(a, "x").collect()} == {0: 1.5, 1: 4}
    with pytest.raises(ValueError):
        op.align(a, make(spark, [[1.0]]), lambda x, y: x)


def test_dataset_rule(six):
    plain = GridSet({"stuff": six}, {"meta": (1, [1, 2])})
    assert plain.clip_box(425493, 4615300, 425532, 4615500).others == plain.others
    mixed = GridSet({"stuff": six}, {"bounds": (2, None)})
    with pytest.raises(errors.MissingSpatialDimension):
        mixed.reproject(4326)
    with options.set_options(skip_missing_spatial_dims=True):
        out = mixed.reproject(4326)
    assert out.vars == ["stuff", "bounds"] and out.grids["stuff"].meta.shape == (8, 2)
    assert plain.crs.code == "EPSG:26915"
    with pytest.raises(errors.RasterError):
        _ = GridSet({"a": six, "b": six.with_(crs=parse_crs(4326))}).crs
    with pytest.raises(errors.MissingCrs):
        _ = GridSet({"a": six.with_(crs=None)}).crs


def test_stack_and_columns(spark, six):
    both = GridSet({"red": six, "nir": six.map(lambda v: v * 2)}, {})
    one = GridSet({k: op.isel(g, band=0) for k, g in both.grids.items()}, {})
    arr = one.to_array()
    assert arr.meta.count == 2 and (dense(arr)[1] == 2 * dense(arr)[0]).all()
    back = op.stack_columns(op.bands_as_columns(arr), ["band_1", "band_2"])
    assert back.exceptAll(arr.df).isEmpty()


def test_filters_reach_the_scan(spark, tmp_path, six):
    six.df.write.parquet(str(tmp_path / "cells"))
    g = six.with_(spark.read.parquet(str(tmp_path / "cells")))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = op.clip_box(g, 425493, 4615300, 425532, 4615500).df._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(row" in pushed and "LessThan(col" in pushed


def test_small_changes(spark, six):
    one = op.isel(six, band=0)
    assert one.squeeze().meta.extra_dim is None and six.squeeze() is six
    assert one.rename("t").value == "t" and one.assign_transform(Affine(1, 0, 0, 0, -1, 6)).meta.bounds() == (0, 0, 6, 6)
    assert one.where(lambda v: v > 30).valid().count() == 5 and one.where(lambda v: v > 30).fillna(0.0).df.where("value = 0").count() == 31
    assert GridSet({"a": one, "b": one}, {"c": (1, None)}).drop_vars("a", "c").vars == ["b"]


def test_gap_filling_over_blocks_and_ties(spark, monkeypatch):
    """Blocks of one and of a few columns, rows without valid cells, and unit cells, where ties go to the smaller row and column."""
    from gridloom.operators import gapfill

    rng = np.random.default_rng(8)
    for cells, share in ((1, 0.05), (100, 0.3), (1 << 19, 0.01)):
        monkeypatch.setattr(gapfill, "COLUMN_CELLS", cells)
        data = rng.uniform(0, 9, (2, 23, 17))
        data[rng.uniform(size=data.shape) > share] = np.nan
        data[0, 4, 3] = 5.0
        got = dense(op.interpolate_na(make(spark, data, Affine(1, 0, 0, 0, -1, 23), nodata=math.nan)))
        for b in range(2):
            r, c = np.nonzero(~np.isnan(data[b]))
            for i in range(23 if len(r) else 0):
                for j in range(17):
                    k = np.lexsort((c, r, (c - j) ** 2 + (r - i) ** 2))[0]
                    assert got[b, i, j] == data[b, r[k], c[k]]
