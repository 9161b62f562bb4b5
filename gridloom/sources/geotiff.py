"""GeoTIFF files: strips or tiles, plain or compressed, any integer or float type, from the file's published layout.

Reading takes the directory from the file's head and only the blocks of a
window; writing makes one file of tiles.
"""

from __future__ import annotations

import io
import struct
from xml.sax.saxutils import escape

import numpy as np

from gridloom.functions.affine import Affine
from gridloom.functions.crs import parse_crs
from gridloom.plans.meta import GridMeta
from gridloom.sources.blockcodecs import COMPRESSIONS, OLD_DEFLATE, decode, encode, predicted, unpredicted

#: Numbers of tags and of field types (with their struct codes) in the file format.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284,
    "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "sample_format": 339, "pixel_scale": 33550, "tie_points": 33922, "matrix": 34264, "geo_keys": 34735, "geo_doubles": 34736, "geo_text": 34737, "metadata": 42112, "nodata": 42113,
}
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_NAMES = {v: k for k, v in TAGS.items()}


class TiffReader:
    """One directory of a file opened for random access (``seek`` and ``read``)."""

    def __init__(self, file, directory: int = 0):
        self.file = file
        head = self._at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        self.big = struct.unpack(self.order + "H", head[2:4])[0] == 43
        offset = struct.unpack(self.order + "Q", head[8:16])[0] if self.big else struct.unpack(self.order + "I", head[4:8])[0]
        self.directories = 0
        self.tags: dict[str, tuple] = {}
        while offset:
            tags, offset = self._directory(offset)
            if self.directories == directory:
                self.tags = tags
            self.directories += 1
        if directory >= self.directories:
            raise ValueError(f"the file has {self.directories} levels, not {directory + 1}")
        one = lambda name, default=None: self.tags.get(name, (default,))[0]
        self.width, self.height, self.samples = one("width"), one("height"), one("samples", 1)
        self.compression, self.predictor, self.separate = one("compression", 1), one("predictor", 1), one("planar", 1) == 2
        kind = {1: "u", 2: "i", 3: "f", 5: "c", 6: "c"}[one("sample_format", 1)]
        self.dtype = np.dtype(f"{self.order}{kind}{one('bits', 8) // 8}")
        self.tiled = "tile_offsets" in self.tags
        self.block = (one("tile_height"), one("tile_width")) if self.tiled else (min(one("rows_per_strip", self.height), self.height), self.width)
        self.offsets = self.tags["tile_offsets" if self.tiled else "strip_offsets"]
        self.counts = self.tags["tile_counts" if self.tiled else "strip_counts"]
        if self.compression not in (*COMPRESSIONS.values(), OLD_DEFLATE):
            raise ValueError(f"compression {self.compression} is not read here")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _directory(self, offset: int):
        head, entry, count = (8, 20, "Q") if self.big else (2, 12, "H")
        n = struct.unpack(self.order + count, self._at(offset, head))[0]
        data = self._at(offset + head, n * entry + (8 if self.big else 4))
        tags = {}
        for k in range(n):
            e = data[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(self.order + "HH", e[:4])
            n_values = struct.unpack(self.order + ("Q" if self.big else "I"), e[4 : 12 if self.big else 8])[0]
            code = FIELD.get(kind)
            if code is None or tag not in _NAMES:
                continue
            place, room = e[12 if self.big else 8 :], 8 if self.big else 4
            size = struct.calcsize("=" + code) * n_values
            raw = place[:size] if size <= room else self._at(struct.unpack(self.order + ("Q" if self.big else "I"), place)[0], size)
            tags[_NAMES[tag]] = (raw.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{self.order}{len(code) * n_values}{code[0]}", raw)
        return tags, struct.unpack(self.order + ("Q" if self.big else "I"), data[n * entry :])[0]

    def transform(self) -> Affine:
        if "matrix" in self.tags:
            m = self.tags["matrix"]
            return Affine(m[0], m[1], m[3], m[4], m[5], m[7])
        if "pixel_scale" in self.tags and "tie_points" in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags["pixel_scale"], self.tags["tie_points"]
            return Affine(sx, 0, x - i * sx, 0, -sy, y + j * sy)
        return Affine()

    def crs(self):
        keys = self.tags.get("geo_keys", ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        code = found.get(3072) or found.get(2048)
        try:
            return parse_crs(code) if code and code != 32767 else None
        except ValueError:
            return None

    def items(self) -> list[tuple[str, int | None, str | None, str]]:
        """(name, band, role, text) of the metadata document."""
        import xml.etree.ElementTree as ET

        text = self.tags.get("metadata", ("",))[0]
        return [(e.get("name"), int(e.get("sample")) if e.get("sample") else None, e.get("role"), e.text or "") for e in ET.fromstring(text)] if text else []

    def meta(self, name: str = "value") -> GridMeta:
        from gridloom.sources.tags import raster_attrs

        kind = {"u": "uint", "i": "int", "f": "float", "c": "complex"}[self.dtype.kind] + str(self.dtype.itemsize * 8)
        nodata = self.tags.get("nodata", (None,))[0]
        if nodata is not None:
            nodata = float(nodata) if kind.startswith("float") else int(float(nodata))
        items = self.items()
        by_role = lambda role, plain: [next((t for _, b, r, t in items if r == role and b == k), plain) for k in range(self.samples)]
        scales, offsets = ([float(v) for v in by_role(r, d)] for r, d in (("scale", 1), ("offset", 0)))
        attrs = raster_attrs({n: t for n, b, r, t in items if r is None and b in (None, 0)}, nodata, scales, offsets, by_role("description", None), by_role("unittype", None))
        return GridMeta(self.width, self.height, self.transform(), self.crs(), name, kind, nodata, bands=tuple(range(1, self.samples + 1)), attrs=attrs)

    def grid_of_blocks(self) -> tuple[int, int]:
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])

    def read_block(self, band: int, row: int, col: int) -> np.ndarray:
        """One block of a band, cut to the raster's edge."""
        down, across = self.grid_of_blocks()
        k = row * across + col + (band * down * across if self.separate else 0)
        bh, bw = self.block
        depth = 1 if self.separate else self.samples
        rows = min(bh, self.height - row * bh)
        if not self.counts[k]:  # a block that was never written
            data = np.zeros((rows, bw, depth), self.dtype)
        else:
            data = unpredicted(self.predictor, decode(self.compression, self._at(self.offsets[k], self.counts[k])), self.dtype, bw, depth)
        return data[:rows, : min(bw, self.width - col * bw), 0 if self.separate else band].astype(self.dtype.newbyteorder("="))

    def read(self, band: int = 0, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """A window (row_start, row_stop, col_start, col_stop) of a band from the blocks that it meets."""
        r0, r1, c0, c1 = window or (0, self.height, 0, self.width)
        out = np.zeros((max(r1 - r0, 0), max(c1 - c0, 0)), self.dtype.newbyteorder("="))
        bh, bw = self.block
        for br in range(r0 // bh, -(-r1 // bh) if r1 > r0 else 0):
            for bc in range(c0 // bw, -(-c1 // bw) if c1 > c0 else 0):
                data = self.read_block(band, br, bc)
                top, left = br * bh, bc * bw
                a, b = max(r0, top), min(r1, top + data.shape[0])
                c, d = max(c0, left), min(c1, left + data.shape[1])
                if a < b and c < d:
                    out[a - r0 : b - r0, c - c0 : d - c0] = data[a - top : b - top, c - left : d - left]
        return out


def _metadata_xml(tags: dict, scales, offsets, descriptions, units) -> str:
    items = [f'<Item name="{escape(str(k))}">{escape(str(v))}</Item>' for k, v in tags.items()]
    for role, name, values, plain in (("scale", "SCALE", scales, 1.0), ("offset", "OFFSET", offsets, 0.0), ("description", "DESCRIPTION", descriptions, None), ("unittype", "UNITTYPE", units, None)):
        items += [f'<Item name="{name}" sample="{k}" role="{role}">{escape(str(v))}</Item>' for k, v in enumerate(values or ()) if v != plain]
    return f"<GDALMetadata>{''.join(items)}</GDALMetadata>" if items else ""


def tiff_bytes(data: np.ndarray, meta: GridMeta, tile: int = 256, compress: bool | str | None = True, predictor: int = 1, tags=None, scales=None, offsets=None, descriptions=None, units=None) -> bytes:
    """A file of tiles from (bands, rows, columns), bands separate; the type is that of the data.

    compress: "deflate" (True), "lzw", "packbits", "zstd" or None (False); predictor: 1 none, 2 whole numbers, 3 floats.
    """
    compress = {True: "deflate", False: None}.get(compress, compress)
    if compress not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compress!r}; known: {', '.join(filter(None, COMPRESSIONS))}")
    number, predictor = COMPRESSIONS[compress], predictor if compress else 1
    data = data[None] if data.ndim == 2 else data
    bands, height, width = data.shape
    if descriptions and len(descriptions) != bands:
        raise ValueError(f"{len(descriptions)} descriptions for {bands} bands")
    tile = max(16, -(-tile // 16) * 16)
    out = io.BytesIO()
    out.write(struct.pack("<2sHI", b"II", 42, 0))
    offsets_, counts = [], []
    for b in range(bands):
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                block = np.zeros((tile, tile), data.dtype.newbyteorder("<"))
                part = data[b, r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                raw = encode(number, predicted(predictor, block))
                offsets_.append(out.tell())
                counts.append(len(raw))
                out.write(raw)
    t = meta.transform
    fields = [
        ("width", 4, [width]), ("height", 4, [height]), ("bits", 3, [data.dtype.itemsize * 8] * bands), ("compression", 3, [number]), ("predictor", 3, [predictor]), ("photometric", 3, [1]), ("samples", 3, [bands]), ("planar", 3, [2]),
        ("tile_width", 3, [tile]), ("tile_height", 3, [tile]), ("tile_offsets", 4, offsets_), ("tile_counts", 4, counts), ("sample_format", 3, [{"u": 1, "i": 2, "f": 3, "c": 6}[data.dtype.kind]] * bands),
    ]
    if t.rectilinear and t.a > 0 and t.e < 0:
        fields += [("pixel_scale", 12, [t.a, -t.e, 0.0]), ("tie_points", 12, [0.0, 0.0, 0.0, t.c, t.f, 0.0])]
    else:
        fields.append(("matrix", 12, [t.a, t.b, 0.0, t.c, t.d, t.e, 0.0, t.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    if meta.crs and meta.crs.code.startswith("EPSG:"):
        code = int(meta.crs.code[5:])
        model, key = (2, 2048) if meta.crs.geographic else (1, 3072)
        fields.append(("geo_keys", 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, code]))
    nodata = meta.encoded_nodata if meta.encoded_nodata is not None else meta.found_nodata()
    if nodata is not None:
        fields.append(("nodata", 2, f"{nodata}\0"))
    if xml := _metadata_xml(tags or {}, scales, offsets, descriptions, units):
        fields.append(("metadata", 2, xml + "\0"))
    fields.sort(key=lambda f: TAGS[f[0]])
    out.write(b"\0" * (out.tell() % 2))
    place = out.tell()
    extra = place + 2 + 12 * len(fields) + 4
    entries, tail = b"", b""
    for name, kind, values in fields:
        raw = values.encode("latin-1", "xmlcharrefreplace") if kind == 2 else struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        if len(raw) <= 4:
            stored = raw.ljust(4, b"\0")
        else:
            stored = struct.pack("<I", extra + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", TAGS[name], kind, len(raw) if kind == 2 else len(values)) + stored
    out.write(struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + tail)
    done = bytearray(out.getvalue())
    struct.pack_into("<I", done, 4, place)
    return bytes(done)
