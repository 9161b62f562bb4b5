"""Metadata conventions: CRS, transform and dimensions in attributes.

Two conventions are read and written: climate-and-forecast attributes with a
grid-mapping variable, and the ``proj:`` / ``spatial:`` attributes of Zarr
stores.  Reading tries the chosen one, then the other, then plain ``crs`` and
``transform`` attributes.  A dataset is given as plain dictionaries:
``attrs`` of the array, ``encoding``, ``coords`` (name to attributes of the
coordinate, among them the grid-mapping variable) and ``dims``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from gridloom.errors import MissingCrs, MissingSpatialDimension
from gridloom.functions.affine import Affine
from gridloom.functions.crs import Crs, parse_crs
from gridloom.options import get_option

#: Names and ids under which the Zarr conventions are declared.
ZARR_DECLARATIONS = {
    "proj": {"name": "proj:", "uuid": "f17cb550-5864-4468-aeb7-f3180cfb622f", "description": "Coordinate reference system information for geospatial data"},
    "spatial": {"name": "spatial:", "uuid": "689b58e2-cf7b-45e0-9fff-9cfc0883d6b4", "description": "Spatial coordinate information"},
}
DEFAULT_MAPPING = "spatial_ref"


@dataclass(frozen=True)
class Described:
    attrs: dict = field(default_factory=dict)
    encoding: dict = field(default_factory=dict)
    coords: dict = field(default_factory=dict)
    dims: tuple = ()


def mapping_name(d: Described) -> str:
    return d.encoding.get("grid_mapping") or d.attrs.get("grid_mapping") or DEFAULT_MAPPING


def _try_crs(value) -> Crs | None:
    try:
        return parse_crs(value)
    except (ValueError, MissingCrs, KeyError, TypeError):
        return None


class Cf:
    name = "cf"

    @staticmethod
    def read_crs(d: Described) -> Crs | None:
        held = d.coords.get(mapping_name(d), {})
        for key in ("spatial_ref", "crs_wkt"):
            if held.get(key) and (found := _try_crs(held[key])):
                return found
        kind = held.get("grid_mapping_name")
        if kind == "latitude_longitude":
            return parse_crs(4326)
        if kind == "mercator":
            return parse_crs(3395)
        if kind == "sinusoidal":
            return parse_crs("sinusoidal")
        if kind == "transverse_mercator" and held.get("scale_factor_at_central_meridian") == 0.9996:
            zone = int((held["longitude_of_central_meridian"] + 183) / 6)
            return parse_crs((32700 if held.get("false_northing") else 32600) + zone)
        return None

    @staticmethod
    def read_transform(d: Described) -> Affine | None:
        text = d.coords.get(mapping_name(d), {}).get("GeoTransform")
        if text is None:
            return None
        values = text.split() if isinstance(text, str) else text
        return Affine.from_gdal(*map(float, values))

    @staticmethod
    def read_dims(d: Described) -> tuple[str, str] | None:
        for pair in (("x", "y"), ("longitude", "latitude")):
            if all(p in d.dims for p in pair):
                return pair
        x = y = None
        for name in d.dims:
            held = d.coords.get(name, {})
            if held.get("axis") == "X" or held.get("standard_name") in ("longitude", "projection_x_coordinate"):
                x = name
            if held.get("axis") == "Y" or held.get("standard_name") in ("latitude", "projection_y_coordinate"):
                y = name
        return (x, y) if x and y else None

    @staticmethod
    def write_crs(d: Described, crs: Crs, grid_mapping: str | None = None) -> Described:
        name = grid_mapping or mapping_name(d)
        kept = {k: v for k, v in d.coords.get(name, {}).items() if k == "GeoTransform"}
        held = {"spatial_ref": crs.code, "crs_wkt": crs.code} | (cf_parameters(crs) if get_option("export_grid_mapping") else {}) | kept
        attrs = {k: v for k, v in d.attrs.items() if k not in ("crs", "grid_mapping")}
        return Described(attrs, d.encoding | {"grid_mapping": name}, d.coords | {name: held}, d.dims)

    @staticmethod
    def write_transform(d: Described, transform: Affine, grid_mapping: str | None = None, **_) -> Described:
        name = grid_mapping or mapping_name(d)
        held = d.coords.get(name, {}) | {"GeoTransform": transform.geotransform()}
        attrs = {k: v for k, v in d.attrs.items() if k not in ("transform", "grid_mapping")}
        return Described(attrs, d.encoding | {"grid_mapping": name}, d.coords | {name: held}, d.dims)


def cf_parameters(crs: Crs) -> dict:
    """Grid-mapping attributes of a system."""
    from gridloom.functions.crs import ELLIPSOIDS, SINUSOIDAL_RADIUS

    if crs.kind == "sinusoidal":
        return {"grid_mapping_name": "sinusoidal", "earth_radius": SINUSOIDAL_RADIUS, "longitude_of_projection_origin": 0.0, "false_easting": 0.0, "false_northing": 0.0}
    a, inverse = ELLIPSOIDS[crs.datum]
    base = {"semi_major_axis": a, "inverse_flattening": inverse, "longitude_of_prime_meridian": 0.0, "horizontal_datum_name": crs.datum}
    if crs.geographic:
        return {"grid_mapping_name": "latitude_longitude"} | base
    if crs.kind == "utm":
        return {"grid_mapping_name": "transverse_mercator", "latitude_of_projection_origin": 0.0, "longitude_of_central_meridian": 6.0 * crs.zone - 183, "false_easting": 500000.0, "false_northing": 1e7 if crs.south else 0.0, "scale_factor_at_central_meridian": 0.9996} | base
    return {"grid_mapping_name": "mercator", "longitude_of_projection_origin": 0.0, "standard_parallel": 0.0, "false_easting": 0.0, "false_northing": 0.0} | base


def coordinate_attrs(crs: Crs | None, axis: str, unit_factor: float = 1.0) -> dict:
    """Attributes of an x or y coordinate: axis, and names and units by the system."""
    if crs is None:
        return {"axis": axis.upper()}
    if crs.geographic:
        name, unit = (("longitude", "degrees_east"), ("latitude", "degrees_north"))[axis == "y"]
        return {"axis": axis.upper(), "long_name": name, "standard_name": name, "units": unit}
    unit = "metre" if unit_factor == 1 else f"{unit_factor} metre"
    return {"axis": axis.upper(), "long_name": f"{axis} coordinate of projection", "standard_name": f"projection_{axis}_coordinate", "units": unit}


def declared(attrs: dict) -> set[str]:
    """Names of the Zarr conventions that attributes declare."""
    found = attrs.get("zarr_conventions") or []
    return {c.get("name", "").rstrip(":") for c in found if isinstance(c, dict)}


def declare(attrs: dict, name: str) -> dict:
    if name in declared(attrs):
        return dict(attrs)
    return attrs | {"zarr_conventions": [*(attrs.get("zarr_conventions") or []), ZARR_DECLARATIONS[name]]}


class Zarr:
    name = "zarr"

    @staticmethod
    def read_crs(d: Described) -> Crs | None:
        if "proj" not in declared(d.attrs):
            return None
        for key in ("proj:wkt2", "proj:code", "proj:projjson"):
            value = d.attrs.get(key)
            if value and (found := _try_crs(value)):
                return found
        return None

    @staticmethod
    def read_transform(d: Described) -> Affine | None:
        values = d.attrs.get("spatial:transform")
        if "spatial" not in declared(d.attrs) or values is None or len(values) < 6:
            return None
        return Affine(*map(float, values[:6]))

    @staticmethod
    def read_dims(d: Described) -> tuple[str, str] | None:
        names = d.attrs.get("spatial:dimensions")
        if "spatial" not in declared(d.attrs) or not names or len(names) < 2:
            return None
        y, x = names[-2:]
        return (x, y) if x in d.dims and y in d.dims else None

    @staticmethod
    def write_crs(d: Described, crs: Crs, grid_mapping: str | None = None) -> Described:
        return Described(declare(d.attrs, "proj") | {"proj:wkt2": crs.code}, d.encoding, d.coords, d.dims)

    @staticmethod
    def write_transform(d: Described, transform: Affine, grid_mapping: str | None = None, *, shape=None, dims=None) -> Described:
        attrs = declare(d.attrs, "spatial") | {"spatial:transform": list(transform), "spatial:registration": "pixel"}
        if dims:
            attrs["spatial:dimensions"] = list(dims)
        if shape:
            attrs["spatial:shape"] = list(shape)
            attrs["spatial:bbox"] = list(transform.bounds(shape[1], shape[0]))
        return Described(attrs, d.encoding, d.coords, d.dims)


CONVENTIONS = {"cf": Cf, "zarr": Zarr}


def convention(name: str | None = None):
    """The convention for writing: the given one, else the option's, else cf."""
    return CONVENTIONS[name or get_option("convention") or "cf"]


def _in_order():
    first = get_option("convention")
    return sorted(CONVENTIONS.values(), key=lambda c: c.name != first) if first else list(CONVENTIONS.values())


def read_crs(d: Described) -> Crs | None:
    found = next((c for c in (k.read_crs(d) for k in _in_order()) if c), None)
    return found or (_try_crs(d.attrs["crs"]) if d.attrs.get("crs") else None)


def read_transform(d: Described) -> Affine | None:
    found = next((t for t in (k.read_transform(d) for k in _in_order()) if t is not None), None)
    if found is None and d.attrs.get("transform") is not None:
        return Affine(*map(float, d.attrs["transform"][:6]))
    return found


def read_dims(d: Described) -> tuple[str, str]:
    found = next((p for p in (k.read_dims(d) for k in _in_order()) if p), None)
    if found is None:
        raise MissingSpatialDimension(f"no x and y dimension among {d.dims}")
    return found


def write_crs(d: Described, crs, convention_name: str | None = None, grid_mapping: str | None = None) -> Described:
    return convention(convention_name).write_crs(d, parse_crs(crs), grid_mapping)


def write_transform(d: Described, transform: Affine, convention_name: str | None = None, grid_mapping: str | None = None, **more) -> Described:
    return convention(convention_name).write_transform(d, transform, grid_mapping, **more)


def gcps_to_geojson(gcps) -> dict:
    """Ground control points as a feature collection; z only where a point has it."""
    one = lambda g: {"type": "Feature", "properties": {"id": g.get("id", ""), "info": g.get("info", ""), "row": g["row"], "col": g["col"]}, "geometry": {"type": "Point", "coordinates": [g["x"], g["y"], *([g["z"]] if g.get("z") is not None else [])]}}
    return {"type": "FeatureCollection", "features": [one(g) for g in gcps]}


def gcps_from_geojson(value) -> list[dict]:
    value = json.loads(value) if isinstance(value, str) else value
    out = []
    for f in value["features"]:
        x, y, *z = f["geometry"]["coordinates"]
        out.append(f["properties"] | {"x": x, "y": y} | ({"z": z[0]} if z else {}))
    return out


def rpcs_to_json(rpcs: dict) -> str:
    return json.dumps(rpcs)


def rpcs_from_json(text: str) -> dict:
    return json.loads(text)


def parse_rpb(text: str) -> dict:
    """Coefficients from the text of an RPB file, under the names that the warp uses."""
    import re

    body = text.replace("\n", " ")
    number = lambda key: float(re.search(rf"\b{key}\s*=\s*([-+\d.eE]+)", body)[1])
    numbers = lambda key: [float(v) for v in re.search(rf"\b{key}\s*=\s*\(([^)]*)\)", body)[1].split(",")]
    plain = {"line_off": "lineOffset", "samp_off": "sampOffset", "lat_off": "latOffset", "long_off": "longOffset", "height_off": "heightOffset", "line_scale": "lineScale", "samp_scale": "sampScale", "lat_scale": "latScale", "long_scale": "longScale", "height_scale": "heightScale"}
    lists = {"line_num_coeff": "lineNumCoef", "line_den_coeff": "lineDenCoef", "samp_num_coeff": "sampNumCoef", "samp_den_coeff": "sampDenCoef"}
    return {k: number(v) for k, v in plain.items()} | {k: numbers(v) for k, v in lists.items()}
