"""What a raster is besides its cells: size, transform, system, missing values, attributes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from gridloom.errors import DimensionOrder, MissingCrs, OneCellWide, TooManyDimensions
from gridloom.functions import crs as crs_lib
from gridloom.functions.affine import IDENTITY, Affine, Bounds, Window

#: The missing value a type gets where none is given; integers also list their range.
DEFAULT_NODATA = {
    "uint8": 255, "uint16": 65535, "uint32": 4294967295, "uint64": 18446744073709551615,
    "int8": -128, "int16": -32768, "int32": -2147483648, "int64": -9223372036854775808,
    "float16": math.nan, "float32": math.nan, "float64": math.nan,
    "complex64": math.nan, "complex128": math.nan, "complex_int16": None, "complex_int32": None,
}
#: Spark has no unsigned types: each is held in the next wider one.
SPARK_TYPE = {"uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "float16": "float", "float32": "float", "float64": "double"}
FILL_NAMES = ("_FillValue", "missing_value", "fill_value", "nodata")


def integer_range(dtype: str) -> tuple[int, int]:
    bits = int("".join(c for c in dtype if c.isdigit()))
    return (0, 2**bits - 1) if dtype.startswith("u") else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


def exact_nodata(value, dtype: str, original=None):
    """The value as the type holds it; OverflowError if it can't.  Complex types take any, and no value stays none."""
    if value is None or dtype.startswith("complex"):
        return value
    if dtype.startswith("float"):
        return float(value)
    low, high = integer_range(dtype)
    if isinstance(value, float) and (math.isnan(value) or value != math.floor(value)) or not low <= value <= high:
        raise OverflowError(f"missing value {original if original is not None else value} does not fit in {dtype}")
    return int(value)


def default_nodata(dtype: str):
    return DEFAULT_NODATA[dtype]


@dataclass(frozen=True)
class GridMeta:
    """Immutable; ``crs`` is a Crs or None.  Without coordinates only the stored transform gives places."""

    width: int
    height: int
    transform: Affine = IDENTITY
    crs: crs_lib.Crs | None = None
    name: str = "value"
    dtype: str = "float64"
    nodata: float | None = None
    encoded_nodata: float | None = None
    x_dim: str = "x"
    y_dim: str = "y"
    extra_dim: str | None = "band"
    bands: tuple = (1,)
    band_coords: tuple = ()
    has_coords: bool = True
    attrs: dict = field(default_factory=dict)
    encoding: dict = field(default_factory=dict)
    grid_mapping: str = "spatial_ref"
    gcps: tuple = ()
    rpcs: dict | None = None

    @classmethod
    def of_dims(cls, dims: tuple[str, ...], sizes: dict[str, int], x_dim="x", y_dim="y", **more) -> "GridMeta":
        """Meta of an array with named dimensions, which must be (extra, y, x) or (y, x)."""
        extra = [d for d in dims if d not in (x_dim, y_dim)]
        if len(extra) > 1:
            raise TooManyDimensions(f"only one dimension besides ({y_dim}, {x_dim}) is allowed, not {extra}")
        if tuple(dims[-2:]) != (y_dim, x_dim):
            raise DimensionOrder(f"dimensions must end in ({y_dim}, {x_dim}), not {dims}")
        return cls(sizes[x_dim], sizes[y_dim], x_dim=x_dim, y_dim=y_dim, extra_dim=extra[0] if extra else None, bands=tuple(range(1, sizes[extra[0]] + 1)) if extra else (1,), **more)

    def with_(self, **changes) -> "GridMeta":
        return replace(self, **changes)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def count(self) -> int:
        return len(self.bands)

    def resolution(self) -> tuple[float, float]:
        if (self.width == 1 or self.height == 1) and self.transform == IDENTITY and self.has_coords and self.crs is None:
            raise OneCellWide("a single row or column without a transform has no resolution")
        return self.transform.resolution

    def bounds(self) -> Bounds:
        return self.transform.bounds(self.width, self.height)

    def recalculated_transform(self) -> Affine:
        """From bounds and resolution; a rotated or sheared transform stays."""
        if not self.transform.rectilinear:
            return self.transform
        rx, ry = self.resolution()
        left, bottom, right, top = self.bounds()
        return Affine(rx, 0, left if rx > 0 else right, 0, ry, top if ry < 0 else bottom)

    def x_coords(self) -> list[float]:
        return [self.transform.center(k, 0)[0] for k in range(self.width)]

    def y_coords(self) -> list[float]:
        return [self.transform.center(0, k)[1] for k in range(self.height)]

    def coords_2d(self) -> tuple[list[list[float]], list[list[float]]]:
        """xc and yc of a grid that is not rectilinear, row by row."""
        both = [[self.transform.center(c, r) for c in range(self.width)] for r in range(self.height)]
        return [[p[0] for p in row] for row in both], [[p[1] for p in row] for row in both]

    def transform_bounds(self, dst, densify: int = 21) -> Bounds:
        return crs_lib.transform_bounds(self.need_crs(), dst, self.bounds(), densify)

    def estimate_utm_crs(self, datum: str = "WGS 84") -> crs_lib.Crs:
        return crs_lib.utm_crs_of(self.crs, self.bounds(), datum)

    def need_crs(self) -> crs_lib.Crs:
        if self.crs is None:
            raise MissingCrs(f"raster {self.name!r} has no coordinate reference system")
        return self.crs

    def cut(self, w: Window) -> "GridMeta":
        """Meta of a whole-cell window (which may reach outside)."""
        return self.with_(width=w.col_stop - w.col_start, height=w.row_stop - w.row_start, transform=self.transform.shifted(w.col_start, w.row_start))

    # Missing values.

    def found_nodata(self):
        """In memory: an override, NaN where a value is encoded, else the first fill attribute."""
        if self.nodata is not None:
            return self.nodata
        if self.encoded_nodata is not None:
            return math.nan
        return next((exact_nodata(self.attrs[k], self.dtype) for k in FILL_NAMES if self.attrs.get(k) is not None), None)

    def set_nodata(self, value) -> "GridMeta":
        return self.with_(nodata=exact_nodata(value, self.dtype))

    def write_nodata(self, value, encoded: bool = False) -> "GridMeta":
        """Record the missing value in the attributes, or in the encoding (then it is NaN in memory); None removes it."""
        attrs = {k: v for k, v in self.attrs.items() if k not in FILL_NAMES}
        encoding = {k: v for k, v in self.encoding.items() if k not in FILL_NAMES}
        if value is None:
            return self.with_(attrs=attrs, encoding=encoding, nodata=None, encoded_nodata=None)
        if encoded:
            value = exact_nodata(value, self.encoding.get("dtype", self.dtype))
            return self.with_(attrs=attrs, encoding=encoding | {"_FillValue": value}, nodata=None, encoded_nodata=value)
        value = exact_nodata(value, self.dtype)
        return self.with_(attrs=attrs | {"_FillValue": value}, encoding=encoding, nodata=value, encoded_nodata=None)

    def target_nodata(self, value=None):
        """Missing value of a result: the given one, else this raster's, else the type's."""
        found = self.found_nodata()
        return exact_nodata(value, self.dtype) if value is not None else found if found is not None else default_nodata(self.dtype)

    # Metadata.

    def set_attrs(self, attrs: dict) -> "GridMeta":
        return self.with_(attrs=dict(attrs), nodata=None)

    def update_attrs(self, attrs: dict) -> "GridMeta":
        return self.with_(attrs=self.attrs | attrs, nodata=None)

    def set_encoding(self, encoding: dict) -> "GridMeta":
        return self.with_(encoding=dict(encoding), encoded_nodata=encoding.get("_FillValue"))

    def update_encoding(self, encoding: dict) -> "GridMeta":
        return self.set_encoding(self.encoding | encoding)

    def write_crs(self, value=None) -> "GridMeta":
        attrs = {k: v for k, v in self.attrs.items() if k != "crs"}
        return self.with_(crs=crs_lib.parse_crs(value) if value is not None else self.need_crs(), attrs=attrs)

    def set_crs(self, value) -> "GridMeta":
        """The old name of write_crs."""
        import warnings

        warnings.warn("set_crs is deprecated; use write_crs", DeprecationWarning, stacklevel=2)
        return self.write_crs(value)

    def coordinate_system(self, unit_factor: float = 1.0) -> dict[str, dict]:
        """Attributes of the x and y coordinates by the system's kind."""
        from gridloom.plans.conventions import coordinate_attrs

        return {self.x_dim: coordinate_attrs(self.crs, "x", unit_factor), self.y_dim: coordinate_attrs(self.crs, "y", unit_factor)}

    def write_transform(self, transform: Affine | None = None, grid_mapping: str | None = None) -> "GridMeta":
        return self.with_(transform=transform or self.recalculated_transform(), grid_mapping=grid_mapping or self.grid_mapping)

    def write_gcps(self, gcps, crs=None) -> "GridMeta":
        meta = self.with_(gcps=tuple(dict(g) for g in gcps))
        return meta.write_crs(crs) if crs else meta

    def write_rpcs(self, rpcs: dict) -> "GridMeta":
        return self.with_(rpcs=dict(rpcs)).write_crs(4326)

    def set_spatial_dims(self, x_dim: str, y_dim: str) -> "GridMeta":
        return self.with_(x_dim=x_dim, y_dim=y_dim)
