"""Tags and names of raster files on the driver: typed values, dimensions, driver vectors, subdataset patterns."""

from __future__ import annotations

import datetime
import re


def number(text: str):
    """int, else float, else the text."""
    for kind in (int, float):
        try:
            return kind(text)
        except (TypeError, ValueError):
            pass
    return text


def parse_tag(name: str, value):
    """(name without the global prefix, number, list of numbers for "{a,b}", or text)."""
    name = name.removeprefix("NC_GLOBAL#")
    if isinstance(value, str) and value.startswith("{") and value.endswith("}"):
        items = [number(v.strip()) for v in value[1:-1].split(",")]
        return name, [float(v) for v in items] if all(isinstance(v, (int, float)) for v in items) else value
    return name, number(value) if isinstance(value, str) else value


def parse_tags(tags: dict) -> dict:
    return dict(parse_tag(k, v) for k, v in tags.items())


def global_attrs_out(tags: dict, variable_tags: list[dict]) -> list[dict]:
    """Variables' tags without those that the file has for all of them."""
    return [{k: v for k, v in own.items() if tags.get(k) != v} for own in variable_tags]


def variable_tags(tags: dict, variable: str) -> dict:
    """Tags "variable#name" as the variable's attributes."""
    return {k.split("#", 1)[1]: parse_tag(k, v)[1] for k, v in tags.items() if k.startswith(f"{variable}#")}


def extra_dimensions(tags: dict) -> dict[str, list]:
    """Named dimensions from NETCDF_DIM_EXTRA and their values, which may be single."""
    names = re.findall(r"[^{},\s]+", tags.get("NETCDF_DIM_EXTRA", ""))
    out = {}
    for name in names:
        values = parse_tag("", tags.get(f"NETCDF_DIM_{name}_VALUES", "{}"))[1]
        out[name] = values if isinstance(values, list) else [values]
    return out


def band_vectors(tags: dict, count: int) -> tuple[dict, dict]:
    """(coordinates, attributes): vectors with an entry for each band are coordinates, other tags attributes."""
    parsed = parse_tags(tags)
    coords = {k: v for k, v in parsed.items() if isinstance(v, list) and len(v) == count}
    return coords, {k: v for k, v in parsed.items() if k not in coords}


def raster_attrs(tags: dict, nodata=None, scales=(), offsets=(), descriptions=(), units=()) -> dict:
    """Attributes of a raster: tags, the missing value, scale and offset where all bands agree, names and units."""
    import warnings

    out = parse_tags(tags)
    if nodata is not None:
        out["_FillValue"] = nodata
    for name, values, plain in (("scale_factor", scales, 1.0), ("add_offset", offsets, 0.0)):
        if values and len(set(values)) > 1:
            warnings.warn(f"{name} differs between bands; it is kept as {name}s", stacklevel=2)
            out[f"{name}s"] = list(values)
        elif values and values[0] != plain:
            out[name] = values[0]
    for name, values in (("long_name", descriptions), ("units", units)):
        values = [v for v in values if v]
        if values:
            out[name] = values[0] if len(set(values)) == 1 else list(values)
    return out


def to_encoding(attrs: dict, masked: bool) -> tuple[dict, dict]:
    """(attributes, encoding): what a masked read has used up moves to the encoding."""
    names = ("_FillValue", "missing_value", "scale_factor", "add_offset", "_Unsigned", "dtype", "grid_mapping") if masked else ("grid_mapping", "dtype")
    return {k: v for k, v in attrs.items() if k not in names}, {k: v for k, v in attrs.items() if k in names}


def variable_pattern(groups=None, variables=None) -> str:
    """A regular expression for subdataset names that end in one of the variables, under one of the groups."""
    one = lambda names: "(?:" + "|".join(re.escape(n.strip("/")) for n in ([names] if isinstance(names, str) else names)) + ")"
    if groups and variables:
        return rf"(?:^|[:/]){one(groups)}[:/](?:.*[:/])?{one(variables)}$"
    if variables:
        return rf"(?:^|[:/]){one(variables)}$"
    if groups:
        return rf"(?:^|[:/]){one(groups)}[:/]"
    return r".*"


_SECONDS = {"microsecond": 1e-6, "us": 1e-6, "millisecond": 1e-3, "ms": 1e-3, "second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400, "week": 604800}


def decode_times(values: list, units: str, decode_times=True, decode_timedelta=None) -> list:
    """Coordinates of "unit since time" as datetimes, of a bare time unit as timedeltas; others unchanged."""
    decode_timedelta = decode_times if decode_timedelta is None else decode_timedelta
    unit, _, since = units.partition(" since ")
    unit = unit.strip().lower()
    scale = _SECONDS.get(unit) or _SECONDS.get(unit.rstrip("s"))
    if scale is None or since and not decode_times or not since and not decode_timedelta:
        return list(values)
    steps = [datetime.timedelta(seconds=v * scale) for v in values]
    return [datetime.datetime.fromisoformat(since.strip()) + s for s in steps] if since else steps


#: Name endings of raster files that a reader here or a plugin takes.
RASTER_ENDINGS = ("asc", "geotif", "geotiff", "img", "j2k", "jp2", "jpg", "jpeg", "png", "tif", "tiff", "vrt")


def looks_like_raster(path: str) -> bool:
    return str(path).rpartition(".")[2].lower() in RASTER_ENDINGS
