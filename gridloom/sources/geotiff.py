"""GeoTIFF files as bytes: a reader and a writer with numpy and zlib.

Reads classic and big files of either byte order, in strips or tiles, with pixels or
bands apart, uncompressed, with Deflate, PackBits or LZW, with the horizontal and the
floating-point predictor. Writes classic little-endian files in strips with Deflate.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the file format: field types (code: struct letter, bytes) and tags.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
KINDS = {1: "u", 2: "i", 3: "f"}
PROJECTED, GEOGRAPHIC, MODEL, RASTER = 3072, 2048, 1024, 1025


@dataclass(frozen=True)
class Grid:
    """Where a raster lies: left edge, cell width, upper edge, cell height (negative: rows go down), size, EPSG code, and the value of missing cells."""

    left: float = 0.0
    dx: float = 1.0
    top: float = 0.0
    dy: float = -1.0
    width: int = 0
    height: int = 0
    epsg: int | None = None
    nodata: float | None = None

    def window(self, row: int, col: int, height: int, width: int) -> Grid:
        """The grid of a part."""
        return Grid(self.left + col * self.dx, self.dx, self.top + row * self.dy, self.dy, width, height, self.epsg, self.nodata)

    def box(self, minx: float, miny: float, maxx: float, maxy: float) -> tuple[int, int, int, int]:
        """First row, first column, rows and columns that a box covers; lengths are rounded to whole cells."""
        return int(np.floor((maxy - self.top) / self.dy + 1e-9)), int(np.floor((minx - self.left) / self.dx + 1e-9)), round((miny - maxy) / self.dy), round((maxx - minx) / self.dx)


@dataclass
class Tiff:
    """An open file: its grid and how its pixels are stored."""

    raw: bytes
    order: str = "<"
    tags: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.order = {b"II": "<", b"MM": ">"}.get(self.raw[:2], "")
        if not self.order:
            raise ValueError("no TIFF file")
        version = self._get("H", 2)[0]
        if version not in (42, 43):
            raise ValueError("no TIFF file")
        big = version == 43
        at = self._get("Q" if big else "I", 8 if big else 4)[0]
        n = self._get("Q" if big else "H", at)[0]
        at += 8 if big else 2
        for _ in range(n):
            tag, kind = self._get("HH", at)
            count = self._get("Q" if big else "I", at + 4)[0]
            letter, size = TYPES.get(kind, ("B", 1))
            inline = 8 if big else 4
            place = at + (12 if big else 8)
            start = place if count * size <= inline else self._get("Q" if big else "I", place)[0]
            if letter == "s":
                self.tags[tag] = (self.raw[start : start + count],)
            else:
                self.tags[tag] = self._get(f"{count * len(letter)}{letter[0]}", start)
            at += 20 if big else 12

    def _get(self, fmt: str, at: int) -> tuple:
        return struct.unpack_from(self.order + fmt, self.raw, at)

    def one(self, tag: int, default: int = 0) -> int:
        return int(self.tags.get(tag, (default,))[0])

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{KINDS[self.one(SAMPLE_FORMAT, 1)]}{self.one(BITS, 8) // 8}")

    @property
    def grid(self) -> Grid:
        left = top = 0.0
        dx, dy = 1.0, -1.0
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            left, dx, top, dy = m[3], m[0], m[7], m[5]
        elif PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            i, j, _, x, y, _ = self.tags[TIEPOINT][:6]
            dx, dy = self.tags[PIXEL_SCALE][0], -self.tags[PIXEL_SCALE][1]
            left, top = x - i * dx, y - j * dy
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        text = self.tags.get(NODATA, (b"",))[0].rstrip(b"\0 ").decode("ascii", "replace")
        return Grid(left, dx, top, dy, self.one(WIDTH), self.one(HEIGHT), codes.get(PROJECTED) or codes.get(GEOGRAPHIC), float(text) if text else None)

    def read(self, band: int = 1, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """A band (from 1 on), or of it a window (first row, first column, rows, columns), which must lie inside; only its strips or tiles are decoded."""
        width, height, n = self.one(WIDTH), self.one(HEIGHT), self.bands
        if not 1 <= band <= n:
            raise ValueError(f"no band {band}")
        row, col, rows, cols = window or (0, 0, height, width)
        if row < 0 or col < 0 or rows < 1 or cols < 1 or row + rows > height or col + cols > width:
            raise ValueError("the window lies outside")
        tiled = TILE_OFFSETS in self.tags
        bw, bh = (self.one(TILE_WIDTH), self.one(TILE_HEIGHT)) if tiled else (width, min(self.one(ROWS_PER_STRIP, height), height))
        offsets, sizes = (self.tags[t] for t in ((TILE_OFFSETS, TILE_SIZES) if tiled else (STRIP_OFFSETS, STRIP_SIZES)))
        across, down = -(-width // bw), -(-height // bh)
        apart = self.one(PLANAR, 1) == 2
        per = 1 if apart else n
        out = np.empty((rows, cols), self.dtype)
        for y in range(row // bh, (row + rows - 1) // bh + 1):
            for x in range(col // bw, (col + cols - 1) // bw + 1):
                k = y * across + x + (band - 1) * across * down * apart
                high = bh if tiled else min(bh, height - y * bh)
                block = self._block(self.raw[offsets[k] : offsets[k] + sizes[k]], high, bw, per)[:, :, 0 if apart else band - 1]
                r0, r1, c0, c1 = max(row, y * bh), min(row + rows, y * bh + high), max(col, x * bw), min(col + cols, x * bw + bw)
                out[r0 - row : r1 - row, c0 - col : c1 - col] = block[r0 - y * bh : r1 - y * bh, c0 - x * bw : c1 - x * bw]
        return out

    def _block(self, raw: bytes, rows: int, cols: int, per: int) -> np.ndarray:
        how, guess = self.one(COMPRESSION, 1), self.one(PREDICTOR, 1)
        if how in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif how == LZW:
            raw = unlzw(raw)
        elif how == PACKBITS:
            raw = unpackbits(raw)
        elif how != NONE:
            raise ValueError(f"compression {how} is not supported")
        size = self.dtype.itemsize
        raw = raw[: rows * cols * per * size]
        if guess == 3:  # bytes of a row by their weight, as differences
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, size, cols * per)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(rows, cols, per).astype(self.dtype)
        block = np.frombuffer(raw, self.dtype.newbyteorder(self.order)).reshape(rows, cols, per).astype(self.dtype)
        return np.cumsum(block, axis=1, dtype=self.dtype) if guess == 2 else block


def unlzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest first; 256 empties the table, 257 ends."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else last + last[:1]
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def unpackbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def encode(bands: np.ndarray, grid: Grid, rows_per_strip: int = 64) -> bytes:
    """The bytes of a file with bands (band x row x column, or row x column), bands apart, compressed with Deflate."""
    bands = bands[None] if bands.ndim == 2 else bands
    n, height, width = bands.shape
    kind = bands.dtype.newbyteorder("<")
    strips = [zlib.compress(np.ascontiguousarray(b[r : r + rows_per_strip]).astype(kind).tobytes(), 6) for b in bands for r in range(0, height, rows_per_strip)]
    formats = {"u": 1, "i": 2, "f": 3}
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bands.dtype.itemsize * 8] * n), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (STRIP_OFFSETS, 4, None),
        (SAMPLES, 3, [n]), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_SIZES, 4, [len(s) for s in strips]), (PLANAR, 3, [2]), (SAMPLE_FORMAT, 3, [formats[bands.dtype.kind]] * n),
        (PIXEL_SCALE, 12, [grid.dx, -grid.dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, grid.left, grid.top, 0.0]),
    ]
    if grid.epsg:
        flat = 4000 <= grid.epsg < 5000
        fields.append((GEO_KEYS, 3, [1, 1, 0, 3, MODEL, 0, 1, 2 if flat else 1, RASTER, 0, 1, 1, GEOGRAPHIC if flat else PROJECTED, 0, 1, grid.epsg]))
    if grid.nodata is not None:
        fields.append((NODATA, 2, f"{grid.nodata:.17g}".encode() + b"\0"))
    fields.sort(key=lambda f: f[0])
    at = 8 + 2 + 12 * len(fields) + 4
    extra, entries = b"", b""
    size = sum(_length(f, len(strips)) for f in fields)
    first = at + size
    starts = np.cumsum([first, *[len(s) for s in strips[:-1]]]).tolist()
    for tag, code, values in fields:
        values = starts if tag == STRIP_OFFSETS else values
        body = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[code][0]}", *values)
        if len(body) <= 4:
            place = body.ljust(4, b"\0")
        else:
            place = struct.pack("<I", at + len(extra))
            extra += body + b"\0" * (len(body) % 2)
        entries += struct.pack("<HHI", tag, code, len(values)) + place
    if first + sum(len(s) for s in strips) >= 1 << 32:
        raise ValueError("too large for one file")
    return b"II" + struct.pack("<HIH", 42, 8, len(fields)) + entries + b"\0\0\0\0" + extra + b"".join(strips)


def _length(f: tuple, strips: int) -> int:
    """Bytes that a field takes behind the directory."""
    tag, code, values = f
    n = (strips if tag == STRIP_OFFSETS else len(values)) * TYPES[code][1]
    return 0 if n <= 4 else n + n % 2
