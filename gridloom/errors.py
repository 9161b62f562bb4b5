"""Errors of raster operations."""


class RasterError(Exception):
    """Base of all errors here."""


class NoCellsInBounds(RasterError):
    """A selection leaves no cell."""


class SingleVariableExpected(RasterError):
    """A raster of one variable is needed."""


class DimensionError(RasterError):
    """Something is wrong with dimensions."""


class MissingSpatialDimension(DimensionError):
    """A spatial dimension can't be found."""


class TooManyDimensions(DimensionError):
    """More than one dimension besides the spatial ones."""


class DimensionOrder(DimensionError):
    """Dimensions are not (extra, y, x)."""


class OneCellWide(DimensionError):
    """A raster has a single row or column where more are needed."""


class MissingCoordinates(RasterError):
    """A dimension has no coordinates."""


class MissingCrs(RasterError):
    """A coordinate reference system is needed."""
