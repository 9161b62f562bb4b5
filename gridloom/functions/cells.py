"""Value expressions: masking, scaling, unsigned types, tags and times.  All are Columns inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.plans.meta import SPARK_TYPE, exact_nodata, integer_range


def mask(value: Column, nodata) -> Column:
    """The value as double, null where it is missing."""
    v = value.cast("double")
    if nodata is None:
        return v
    return F.when(~F.isnan(v), v) if nodata != nodata else F.when(v != F.lit(float(nodata)), v)


def unmask(value: Column, nodata, dtype: str) -> Column:
    """Back to a stored type: null and NaN become the missing value."""
    fill = F.lit(exact_nodata(nodata, dtype))
    return F.when(value.isNull() | F.isnan(value.cast("double")), fill).otherwise(value).cast(SPARK_TYPE[dtype])


def decode(value: Column, scale: float = 1.0, offset: float = 0.0, nodata=None) -> Column:
    """value * scale + offset, null where the stored value is missing."""
    return mask(value, nodata) * F.lit(float(scale)) + F.lit(float(offset))


def decode_by_band(value: Column, band: Column, scales, offsets, nodata=None) -> Column:
    """decode with a scale and an offset for each band, bands counted from 1."""
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), band.cast("int"))
    return mask(value, nodata) * pick(scales) + pick(offsets)


def encode(value: Column, scale: float, offset: float, nodata, dtype: str) -> Column:
    """The reverse of decode: rounded for integer types."""
    raw = (value - F.lit(float(offset))) / F.lit(float(scale))
    return unmask(raw if dtype.startswith("float") else F.round(raw), nodata, dtype)


def as_unsigned(value: Column, dtype: str) -> Column:
    """Bits of a signed integer read as the unsigned type of its width."""
    _, high = integer_range("u" + dtype.removeprefix("u"))
    return F.when(value < 0, value.cast("decimal(20,0)") + F.lit(high + 1).cast("decimal(20,0)")).otherwise(value).cast(SPARK_TYPE["u" + dtype.removeprefix("u")])


def as_signed(value: Column, dtype: str) -> Column:
    """The reverse of as_unsigned."""
    low, high = integer_range(dtype.removeprefix("u"))
    wide = value.cast("decimal(20,0)")
    return F.when(wide > high, wide - F.lit(high - low + 1).cast("decimal(20,0)")).otherwise(wide).cast(SPARK_TYPE[dtype.removeprefix("u")])


def tag_vector(text: Column) -> Column:
    """"{1,2,3}" as an array of doubles; null for other texts."""
    inner = F.regexp_extract(text, r"^\{(.*)\}$", 1)
    return F.when(text.rlike(r"^\{.*\}$"), F.transform(F.split(inner, ","), lambda s: s.try_cast("double")))


def cf_time(value: Column, units: str) -> Column:
    """Numbers of "<unit> since <time>" as timestamps without zone; of a bare unit as intervals."""
    unit, _, since = units.partition(" since ")
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "millisecond": 1e-3, "microsecond": 1e-6}
    key = {"s": "second", "sec": "second", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "ms": "millisecond", "us": "microsecond"}.get(unit.lower().strip(), unit.lower().strip().rstrip("s"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (value * F.lit(float(seconds[key]))).cast("decimal(18,6)"))
    return F.lit(since.strip()).cast("timestamp_ntz") + step if since else step
