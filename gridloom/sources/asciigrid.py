"""ASCII grids: a header of corner, cell size and missing value, then rows of numbers."""

from __future__ import annotations

import re

import numpy as np

from gridloom.functions.affine import Affine
from gridloom.plans.meta import GridMeta


def parse(text: str, name: str = "value") -> tuple[np.ndarray, GridMeta]:
    """(rows, meta) of a grid's text."""
    head = dict((k.lower(), v) for k, v in re.findall(r"^\s*([A-Za-z_]+)\s+(\S+)\s*$", text, re.M))
    body = re.sub(r"^\s*[A-Za-z_]+\s+\S+\s*$", "", text, flags=re.M).split()
    width, height = int(head["ncols"]), int(head["nrows"])
    dx, dy = float(head.get("dx", head.get("cellsize", 1))), float(head.get("dy", head.get("cellsize", 1)))
    left = float(head["xllcorner"]) if "xllcorner" in head else float(head["xllcenter"]) - dx / 2
    bottom = float(head["yllcorner"]) if "yllcorner" in head else float(head["yllcenter"]) - dy / 2
    whole = not any(c in v.lower() for v in body for c in ".en")
    nodata = head.get("nodata_value")
    data = np.array(body, "int64" if whole else "float64").reshape(height, width)
    kind = "float64" if not whole else "int32" if not data.size or np.abs(data).max() < 1 << 31 else "int64"
    data = data.astype(kind)
    meta = GridMeta(width, height, Affine(dx, 0, left, 0, -dy, bottom + height * dy), name=name, dtype=kind, nodata=None if nodata is None else int(nodata) if whole else float(nodata))
    return data, meta


def render(data: np.ndarray, meta: GridMeta) -> str:
    """The text of a north-up grid with square cells."""
    t = meta.transform
    if not t.rectilinear or t.a != -t.e:
        raise ValueError("an ASCII grid needs square cells, north up")
    left, bottom, _, _ = meta.bounds()
    nodata = meta.found_nodata() if meta.encoded_nodata is None else meta.encoded_nodata
    head = [f"ncols {meta.width}", f"nrows {meta.height}", f"xllcorner {left!r}", f"yllcorner {bottom!r}", f"cellsize {t.a!r}"]
    if nodata is not None and nodata == nodata:
        head.append(f"NODATA_value {nodata}")
        data = np.where(np.isnan(data.astype(float)), nodata, data)
    whole = not meta.dtype.startswith("float")
    rows = (" ".join(str(int(v)) if whole else repr(float(v)) for v in row) for row in data)
    return "\n".join([*head, *rows]) + "\n"
