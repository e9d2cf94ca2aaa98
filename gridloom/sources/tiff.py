"""Tiled GeoTIFF files: header, tile decoding, and a small writer for fixtures. numpy and the standard library only."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np

from gridloom.errors import SourceError

# TIFF field types (struct code) and tags.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 277, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, STRIP_OFFSETS, SAMPLE_FORMAT = 322, 323, 324, 325, 273, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits", ZSTD: "zstd", 7: "jpeg"}


@dataclass
class Level:
    """One image of the file: the raster itself, an overview or a mask."""

    tags: dict
    order: str

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None or len(v) == 0 else v[0]

    @property
    def width(self) -> int:
        return self.one(WIDTH)

    @property
    def height(self) -> int:
        return self.one(HEIGHT)

    @property
    def tile(self) -> tuple[int, int]:
        """Width and height of a tile."""
        if TILE_WIDTH not in self.tags:
            raise SourceError("rasters in strips are not supported; rewrite the file with tiles")
        return self.one(TILE_WIDTH), self.one(TILE_HEIGHT)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def planar(self) -> bool:
        return self.one(PLANAR, 1) == 2

    @property
    def grid(self) -> tuple[int, int]:
        """Tiles across and down."""
        w, h = self.tile
        return -(-self.width // w), -(-self.height // h)

    @property
    def dtype(self) -> np.dtype:
        bits, forms = set(self.tags.get(BITS, (1,))), set(self.tags.get(SAMPLE_FORMAT, (1,)))
        if len(bits) > 1 or len(forms) > 1:
            raise SourceError("bands of different types are not supported")
        bits, form = bits.pop(), forms.pop()
        if bits == 1:
            return np.dtype(bool)
        kind = {1: "u", 2: "i", 3: "f"}.get(form)
        if kind is None or bits % 8:
            raise SourceError(f"samples of {bits} bits in format {form} are not supported")
        return np.dtype(f"{self.order}{kind}{bits // 8}")


@dataclass
class Raster:
    """An opened file."""

    path: str
    levels: list[Level]
    masks: dict[int, Level]
    transform: tuple[float, ...] | None
    keys: dict
    nodata: float | None
    band_names: list[str]
    scale: list[float | None]
    offset: list[float | None]
    metadata: dict[str, str] = field(default_factory=dict)
    band_metadata: list[dict[str, str]] = field(default_factory=list)

    @property
    def epsg(self) -> int | None:
        code = self.keys.get(3072) or (self.keys.get(2048) if self.keys.get(1024) == 2 else None)
        return None if code in (None, 32767) else code

    def level_transform(self, k: int) -> tuple[float, ...]:
        if self.transform is None:
            raise SourceError(f"{self.path} is not georeferenced")
        a, b, c, d, e, f = self.transform
        sx, sy = self.levels[0].width / self.levels[k].width, self.levels[0].height / self.levels[k].height
        return a, b * sx, c * sy, d, e * sx, f * sy


def unpack_at(form: str, data, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


class Pieces:
    """Slices of a file, fetched by pieces of PIECE bytes that are each read once; get(offset, size) reads."""

    PIECE = 1 << 18

    def __init__(self, get):
        self.get, self.held = get, {}

    def __getitem__(self, part: slice) -> bytes:
        first, last = part.start // self.PIECE, max(part.start, part.stop - 1) // self.PIECE
        for k in range(first, last + 1):
            if k not in self.held:
                self.held[k] = self.get(k * self.PIECE, self.PIECE)
        whole = b"".join(self.held[k] for k in range(first, last + 1))
        return whole[part.start - first * self.PIECE : part.stop - first * self.PIECE]


def parse_directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict, int]:
    """Tags of the directory at `at`, and where the next one is."""
    head, entry, wide = ("Q", 20, "Q") if big else ("H", 12, "I")
    (n,) = unpack_at(order + head, data, at)
    at += struct.calcsize(head)
    tags = {}
    for i in range(n):
        tag, kind, count = unpack_at(f"{order}HH{wide}", data, at + i * entry)
        code = TYPES.get(kind)
        if code is None:
            continue
        width = 1 if code == "s" else struct.calcsize("=" + code)
        where = at + i * entry + (12 if big else 8)
        if count * width > (8 if big else 4):
            (where,) = unpack_at(order + wide, data, where)
        if code == "s":
            tags[tag] = (data[where : where + count].split(b"\0")[0].decode("utf-8", "replace"),)
        else:
            tags[tag] = unpack_at(f"{order}{count * len(code)}{code[0]}", data, where)
    (following,) = unpack_at(order + wide, data, at + n * entry)
    return tags, following


def open_raster(path: str, read) -> Raster:
    """Header of a file; read(path) gives its bytes, or Pieces of them."""
    data = read(path)
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[0:2]))
    magic = unpack_at(f"{order}H", data, 2)[0] if order else 0
    if magic not in (42, 43):
        raise SourceError(f"{path} is not a TIFF file")
    big = magic == 43
    (at,) = unpack_at(order + ("Q" if big else "I"), data, 8 if big else 4)
    images = []
    while at:
        tags, at = parse_directory(data, at, order, big)
        images.append(Level(tags, order))
    levels = [x for x in images if not x.one(SUBFILE, 0) & 4]
    masks = {i: m for m in images if m.one(SUBFILE, 0) & 4 for i, x in enumerate(levels) if (m.width, m.height) == (x.width, x.height)}
    first = levels[0]
    items, per_band = gdal_metadata(first.one(GDAL_METADATA), first.bands)
    n = first.bands
    names = [per_band[i].pop("\0DESCRIPTION", None) or f"band_{i + 1:02d}" for i in range(n)]
    number = lambda i, key: float(per_band[i].pop(key)) if key in per_band[i] else None
    scale, offset = [number(i, "\0SCALE") for i in range(n)], [number(i, "\0OFFSET") for i in range(n)]
    return Raster(path, levels, masks, geotransform(first), geo_keys(first), parse_nodata(first), names, scale, offset, items, per_band)


def gdal_metadata(text: str | None, bands: int) -> tuple[dict[str, str], list[dict[str, str]]]:
    """Items of the default domain for the file and each band; roles of a band's description, scale and offset are marked by a NUL."""
    from html import unescape

    whole, per_band = {}, [{} for _ in range(bands)]
    if text:
        for item in ElementTree.fromstring(text).iter("Item"):
            value, sample, role = unescape(item.text or ""), item.get("sample"), (item.get("role") or "").lower()
            if role in ("description", "scale", "offset") and sample is not None:
                per_band[int(sample)]["\0" + role.upper()] = value
            elif not item.get("domain"):
                (whole if sample is None else per_band[int(sample)])[item.get("name")] = value
    return whole, per_band


def geotransform(x: Level) -> tuple[float, ...] | None:
    """(x0, dx/dcol, dx/drow, y0, dy/dcol, dy/drow) of pixel corners; a file that ties pixel centres is moved back half a pixel."""
    if TRANSFORM in x.tags:
        m = x.tags[TRANSFORM]
        t = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in x.tags and TIEPOINT in x.tags:
        (sx, sy), (i, j, _, px, py) = x.tags[PIXEL_SCALE][:2], x.tags[TIEPOINT][:5]
        t = (px - i * sx, sx, 0.0, py + j * sy, 0.0, -sy)
    else:
        return None
    if geo_keys(x).get(1025) == 2:
        t = (t[0] - (t[1] + t[2]) / 2, t[1], t[2], t[3] - (t[4] + t[5]) / 2, t[4], t[5])
    return t


def geo_keys(x: Level) -> dict:
    raw, out = x.tags.get(GEO_KEYS, ()), {}
    for i in range(4, len(raw) - 3, 4):
        key, where, count, value = raw[i : i + 4]
        if where == 0:
            out[key] = value
        elif where == GEO_DOUBLES:
            got = x.tags[GEO_DOUBLES][value : value + count]
            out[key] = got[0] if count == 1 else got
        elif where == GEO_ASCII:
            out[key] = x.one(GEO_ASCII, "")[value : value + count].rstrip("|")
    return out


def parse_nodata(x: Level) -> float | None:
    """The missing code; of single-precision files, as rounded to single precision."""
    text = x.one(GDAL_NODATA)
    if text is None:
        return None
    try:
        v = float(text.strip())
    except ValueError:
        return None
    return float(np.float32(v)) if x.dtype == np.dtype(x.order + "f4") else v


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits, 256 clears and 257 ends."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def unpack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompress(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    raise SourceError(f"compression {NAMES.get(compression, compression)} is not supported")


def decode_tile(level: Level, data: bytes, samples: int) -> np.ndarray:
    """Height x width x samples of one tile's bytes."""
    w, h = level.tile
    kind = level.dtype
    raw = unpack(data, level.one(COMPRESSION, NONE))
    if kind == bool:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1)[:, : w * samples].reshape(h, w, samples).astype(bool)
    predictor = level.one(PREDICTOR, 1)
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(h, -1, samples)
        moved = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * samples)
        return np.ascontiguousarray(moved.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w, samples)
    a = np.frombuffer(raw, kind, h * w * samples).reshape(h, w, samples)
    if predictor == 2:
        whole = a.astype(kind.newbyteorder("=")).view(f"u{kind.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(kind.newbyteorder("="))
    return a


def tile_places(level: Level, tx: int, ty: int, bands: list[int]) -> list[tuple[int, int]]:
    """(offset, size) of the byte ranges that hold a tile's bands: one each if planar, else one."""
    across, down = level.grid
    i, offsets, counts = ty * across + tx, level.tags[TILE_OFFSETS], level.tags[TILE_COUNTS]
    return [(offsets[i + b * across * down], counts[i + b * across * down]) for b in bands] if level.planar else [(offsets[i], counts[i])]


def read_tile(level: Level, tx: int, ty: int, bands: list[int], fetch) -> np.ndarray:
    """Doubles (rows x columns x bands) of a tile cut to the raster; fetch(offset, size) gives bytes. A tile of size 0 is all NaN."""
    w, h = level.tile
    rows, cols = min(h, level.height - ty * h), min(w, level.width - tx * w)
    parts = []
    for offset, size in tile_places(level, tx, ty, bands):
        if size == 0:
            parts.append(np.full((h, w, 1 if level.planar else level.bands), np.nan))
        else:
            parts.append(decode_tile(level, fetch(offset, size), 1 if level.planar else level.bands))
    whole = np.concatenate(parts, axis=2) if level.planar else parts[0][:, :, bands]
    return whole[:rows, :cols].astype(np.float64)


def pack(a: np.ndarray, compression: int, predictor: int) -> bytes:
    """Bytes of a tile (rows x columns x samples) in the array's byte order."""
    h, w, s = a.shape
    if predictor == 2:
        u = a.astype(a.dtype.newbyteorder("=")).view(f"u{a.itemsize}")
        u = np.concatenate([u[:, :1], u[:, 1:] - u[:, :-1]], axis=1)
        raw = u.astype(u.dtype.newbyteorder(a.dtype.byteorder)).tobytes()
    elif predictor == 3:
        planes = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, w * s, a.itemsize).transpose(0, 2, 1).reshape(h, -1, s)
        raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
    else:
        raw = a.tobytes()
    if compression == DEFLATE:
        return zlib.compress(raw)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor().compress(raw)
    if compression == PACKBITS:
        return b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
    return raw


def write_raster(path: str, a: np.ndarray, transform: tuple[float, ...], epsg: int = 4326, nodata: str | None = None, tile: int = 64, compression: int = DEFLATE, predictor: int = 1, planar: bool = False, order: str = "<", names: list[str] | None = None, scale: list[float] | None = None, offset: list[float] | None = None, overviews: list[int] = (), mask: np.ndarray | None = None, point: bool = False) -> None:
    """Write rows x columns x bands as a tiled GeoTIFF; overviews are factors of averaging."""
    a = a[:, :, None] if a.ndim == 2 else a
    bands = a.shape[2]
    items = []
    for i in range(bands):
        for role, v in (("description", names), ("scale", scale), ("offset", offset)):
            if v:
                items.append(f'<Item name="{role.upper()}" sample="{i}" role="{role}">{v[i]}</Item>')
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 2 if point else 1, 2048 if geographic else 3072, 0, 1, epsg]
    x0, dx, _, y0, _, dy = transform
    images = [(a, 0)]
    for f in overviews:
        h, w = a.shape[0] // f * f, a.shape[1] // f * f
        images.append((a[:h, :w].reshape(h // f, f, w // f, f, bands).mean(axis=(1, 3)).astype(a.dtype), 1))
    if mask is not None:
        images.append((mask.astype(np.uint8)[:, :, None], 4))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for k, (img, kind) in enumerate(images):
        img = img.astype(img.dtype.newbyteorder(order))
        h, w, s = img.shape
        offsets, counts = [], []
        for group in [[b] for b in range(s)] if planar else [list(range(s))]:
            for ty in range(0, h, tile):
                for tx in range(0, w, tile):
                    block = np.zeros((tile, tile, len(group)), img.dtype)
                    cut = img[ty : ty + tile, tx : tx + tile][:, :, group]
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    data = pack(block, compression, predictor if kind != 4 else 1)
                    offsets.append(len(out))
                    counts.append(len(data))
                    out += data + b"\0" * (len(data) % 2)
        form = {"u": 1, "i": 2, "f": 3}[img.dtype.kind]
        tags = [
            (SUBFILE, "I", [kind]), (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [img.itemsize * 8] * s), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [s]),
            (PLANAR, "H", [2 if planar else 1]), (PREDICTOR, "H", [predictor if kind != 4 else 1]), (TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts), (SAMPLE_FORMAT, "H", [form] * s),
        ]
        if k == 0:
            half = 0.5 if point else 0.0
            tags += [(PIXEL_SCALE, "d", [dx, -dy, 0]), (TIEPOINT, "d", [0, 0, 0, x0 + dx * half, y0 + dy * half, 0]), (GEO_KEYS, "H", keys)]
            tags += [(GDAL_METADATA, "s", f"<GDALMetadata>{''.join(items)}</GDALMetadata>")] if items else []
            tags += [(GDAL_NODATA, "s", nodata)] if nodata is not None else []
        directory = b""
        for tag, code, v in sorted(tags, key=lambda t: t[0]):
            data = v.encode() + b"\0" if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
            number = {"s": 2, "H": 3, "I": 4, "d": 12}[code]
            n = len(data) if code == "s" else len(v)
            if len(data) > 4:
                where = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", where)
            directory += struct.pack(order + "HHI", tag, number, n) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(directory)
        out += struct.pack(order + "H", len(tags)) + directory + struct.pack(order + "I", 0)
    with open(path, "wb") as f:
        f.write(out)
