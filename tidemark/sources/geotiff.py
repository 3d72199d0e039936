"""The GeoTIFF format: headers by byte ranges, single blocks (strips or tiles) in and out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# TIFF field types (struct code by number), sample formats (numpy kind by SampleFormat), compressions.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

Read = Callable[[int, int], bytes]  # (position, length) to bytes


class SceneError(ValueError):
    """A file that is no single-band scene with a reference system."""


@dataclass(frozen=True)
class _Values:
    """Where a tag's values lie; they are read when asked for."""

    form: str
    count: int
    at: int

    def read(self, read: Read, order: str, start: int = 0, stop: int | None = None) -> tuple:
        stop = self.count if stop is None else min(stop, self.count)
        size = struct.calcsize(order + self.form)
        raw = read(self.at + start * size, (stop - start) * size)
        return struct.unpack(f"{order}{stop - start}{self.form}", raw)


@dataclass(frozen=True)
class Header:
    """What the first directory says of a scene. Offsets and sizes of blocks stay in the file until they are needed."""

    order: str
    height: int
    width: int
    nodata: float | None
    crs: str
    affine: tuple[float, ...]
    kind: np.dtype
    compression: int
    predictor: int
    block_height: int
    block_width: int
    offsets: _Values
    sizes: _Values | None
    description: str
    scope: str | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.block_height)

    def corner(self, block: int) -> tuple[int, int]:
        return block // self.across * self.block_height, block % self.across * self.block_width


def bytes_reader(data: bytes) -> Read:
    return lambda at, n: data[at : at + n]


def header(read: Read) -> Header:
    """The header of a classic or big TIFF, by some reads of a few bytes each."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if version == 42:
        (at,), count_form, entry, inline = struct.unpack_from(order + "I", head, 4), "H", "HHI", 4
    elif version == 43 and len(head) == 16:
        (at,), count_form, entry, inline = struct.unpack_from(order + "Q", head, 8), "Q", "HHQ", 8
    else:
        raise SceneError("not a TIFF file")
    step, lead = struct.calcsize(f"={entry}") + inline, struct.calcsize(f"={count_form}")
    (count,) = struct.unpack(order + count_form, read(at, lead))
    directory, found = read(at + lead, count * step), {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + entry, directory, i * step)
        if kind not in _TYPES:
            continue
        place = at + lead + i * step + step - inline
        if struct.calcsize(f"={_TYPES[kind]}") * n > inline:
            (place,) = struct.unpack_from(order + ("I" if inline == 4 else "Q"), directory, i * step + step - inline)
        found[tag] = _Values(_TYPES[kind], n, place)

    def value(tag: int, default=None):
        of = found.get(tag)
        return of.read(read, order, 0, 1)[0] if of else default

    def text(tag: int) -> str:
        of = found.get(tag)
        return read(of.at, of.count).rstrip(b"\0 ").decode("utf-8", "replace") if of else ""

    if value(277, 1) != 1:
        raise SceneError("a scene has exactly one band")
    keys = found[34735].read(read, order) if 34735 in found else ()
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(3072) or codes.get(2048)
    if not code:
        raise SceneError("the file has no reference system")
    if 34264 in found:
        m = found[34264].read(read, order)
        affine = m[0], m[1], m[3], m[4], m[5], m[7]
    elif 33550 in found and 33922 in found:
        sx, sy = found[33550].read(read, order)[:2]
        i, j, _, x, y, _ = found[33922].read(read, order)[:6]
        affine = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    else:
        raise SceneError("the file has no affine transform")
    height, width, tiled = value(257), value(256), 324 in found
    offsets = found.get(324 if tiled else 273)
    if not height or not width or offsets is None:
        raise SceneError("the file has no image")
    bits, sample = value(258, 1), value(339, 1)
    if sample not in _KINDS or bits not in (8, 16, 32, 64) or sample == 3 and bits == 8:
        raise SceneError(f"samples of {bits} bits and format {sample} are not read")
    compression, predictor = value(259, 1), value(317, 1)
    if compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2, 3) or predictor == 3 and sample != 3:
        raise SceneError(f"compression {compression} with predictor {predictor} is not read")
    nodata, about = text(42113), text(42112)
    scope = about.partition('name="normalization_scope">')[2].partition("<")[0] or None
    return Header(
        order, height, width, float(nodata) if nodata else None, f"EPSG:{code}", tuple(map(float, affine)), np.dtype(f"{order}{_KINDS[sample]}{bits // 8}"), compression, predictor,
        value(323) if tiled else min(value(278, height), height), value(322) if tiled else width, offsets, found.get(325 if tiled else 279), text(270), scope,
    )


# --- blocks in -------------------------------------------------------------------------------------------------------


def lzw_decoded(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, upper bits first, that get longer one entry early; 256 clears the table, 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, held, last = [], 9, 0, 0, None
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if last is None:
            found = table[code]
        else:
            found = table[code] if code < len(table) else last + last[:1]
            table.append(last + found[:1])
        out.append(found)
        last = found
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def packbits_decoded(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def block_values(raw: bytes, h: Header, block: int) -> np.ndarray:
    """A block's values within the scene, in single precision."""
    top, left = h.corner(block)
    rows = h.block_height if h.block_width != h.width else min(h.block_height, h.height - top)
    decode = {PLAIN: bytes, LZW: lzw_decoded, PACKBITS: packbits_decoded}.get(h.compression, zlib.decompress)
    n, size = rows * h.block_width, h.kind.itemsize
    data = decode(raw)[: n * size]
    if len(data) < n * size:
        rows = min(rows, h.height - top)
        data = data[: rows * h.block_width * size]
    if h.predictor == 3:
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, size * h.block_width), axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(planes.reshape(rows, size, h.block_width).transpose(0, 2, 1)).view(f">f{size}")[:, :, 0]
    else:
        values = np.frombuffer(data, h.kind).reshape(rows, h.block_width)
        if h.predictor == 2:
            whole = values.view(f"{h.order}u{size}").astype(f"=u{size}")
            values = np.cumsum(whole, axis=1, dtype=f"=u{size}").view(h.kind.newbyteorder("="))
    return values[: h.height - top, : h.width - left].astype(np.float32)


def block_ranges(read: Read, h: Header, first: int, last: int) -> list[tuple[int, int]]:
    """Position and size of the blocks from ``first`` to before ``last``: of the lists of all blocks only this part is read."""
    starts = h.offsets.read(read, h.order, first, last)
    whole = h.block_height * h.block_width * h.kind.itemsize
    return list(zip(starts, h.sizes.read(read, h.order, first, last) if h.sizes else [whole] * len(starts), strict=True))


# --- blocks out ------------------------------------------------------------------------------------------------------


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    known, following = b"", 258
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if longer in table:
            known = longer
            continue
        put(table[known])
        table[longer] = following
        following += 1
        width = min(12, following.bit_length()) if following > 511 else 9
        if following == 4094:
            clear()
            following = 258
        known = data[i : i + 1]
    if known:
        put(table[known])
        following += 1
        width = min(12, following.bit_length()) if following > 511 else 9
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def block_bytes(values: np.ndarray, compression: int, predictor: int = 1) -> bytes:
    """A block as it stands in the file: little-endian values of their own type."""
    rows, width = values.shape
    little = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<")))
    size = little.dtype.itemsize
    if predictor == 2:
        whole = little.view(f"<u{size}")
        data = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1).tobytes()
    elif predictor == 3:
        planes = little.astype(f">f{size}").view(np.uint8).reshape(rows, width, size).transpose(0, 2, 1).reshape(rows, size * width)
        data = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8).tobytes()
    else:
        data = little.tobytes()
    return data if compression == PLAIN else lzw_encoded(data) if compression == LZW else zlib.compress(data, 6)


def _affine_tags(affine: tuple[float, ...]) -> list[tuple]:
    a, b, c, d, e, f = affine
    if b == 0 and d == 0 and a > 0 and e < 0:
        return [(33550, "d", (a, -e, 0.0)), (33922, "d", (0.0, 0.0, 0.0, c, f, 0.0))]
    return [(34264, "d", (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))]


def _crs_keys(crs: str) -> tuple[int, ...]:
    code = int(crs.removeprefix("EPSG:")) if crs.startswith("EPSG:") else 32767
    geographic = 4000 <= code < 5000
    return (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, code)


def frame(height: int, width: int, block_height: int, block_width: int | None, kind: str, compression: int, predictor: int, nodata: float | None, crs: str, affine: tuple[float, ...], sizes: list[int], description: str, scope: str | None, big: bool = False) -> tuple[bytes, bytes]:
    """What stands before and after the blocks (of these sizes, in order) of a file; strips where ``block_width`` is None."""
    dtype = np.dtype(kind)
    first = 16 if big else 8
    starts = np.concatenate([[first], first + np.cumsum(sizes)]).astype(np.int64).tolist()
    directory = starts.pop() + sum(sizes) % 2
    place = "Q" if big else "I"
    about = f'<GDALMetadata><Item name="normalization_scope">{scope}</Item></GDALMetadata>' if scope else ""
    blocks = [(322, "I", (block_width,)), (323, "I", (block_height,)), (324, place, tuple(starts)), (325, place, tuple(sizes))] if block_width else [(273, place, tuple(starts)), (278, "I", (block_height,)), (279, place, tuple(sizes))]
    tags = [
        (256, "I", (width,)), (257, "I", (height,)), (258, "H", (8 * dtype.itemsize,)), (259, "H", (compression,)), (262, "H", (1,)), (270, "s", (description.encode() + b"\0",)), (277, "H", (1,)), (284, "H", (1,)),
        *([(317, "H", (predictor,))] if predictor > 1 else []), *blocks, (339, "H", ({"u": 1, "i": 2, "f": 3}[dtype.kind],)), *_affine_tags(affine), (34735, "H", _crs_keys(crs)),
        *([(42112, "s", (about.encode() + b"\0",))] if about else []), *([(42113, "s", (repr(nodata).encode() + b"\0",))] if nodata is not None else []),
    ]
    numbers = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
    inline, step, lead = (8, 20, 8) if big else (4, 12, 2)
    entries, extra, beyond = b"", b"", directory + lead + step * len(tags) + (8 if big else 4)
    for tag, form, values in sorted(tags):
        packed = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        n = len(packed) if form == "s" else len(values)
        if len(packed) > inline:
            packed, extra = struct.pack(f"<{place}", beyond + len(extra)), extra + packed + b"\0" * (-len(packed) % 8)
        entries += struct.pack(f"<HH{place}", tag, numbers[form], n) + packed.ljust(inline, b"\0")
    head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, directory) if big else struct.pack("<HI", 42, directory))
    tail = b"\0" * (sum(sizes) % 2) + struct.pack("<Q" if big else "<H", len(tags)) + entries + struct.pack(f"<{place}", 0) + extra
    return head, tail
