"""Pictures' headers: size, format and the moment of capture, read from the bytes that formats are defined by."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

#: width, height, format, taken_at
About = tuple[int | None, int | None, str | None, str | None]
UNKNOWN: About = (None, None, None, None)
PIECE = 1 << 20
# The EXIF tags of dates in order of preference (original, digitised, changed), and of the block that holds the first two.
DATES, EXIF_BLOCK = (0x9003, 0x9004, 0x0132), 0x8769


def _exif_date(tiff: bytes) -> str | None:
    """The first date that a TIFF structure holds, as written."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return None
    dates: dict[int, str] = {}
    todo, seen = [struct.unpack_from(order + "I", tiff, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, entry)
            if tag == EXIF_BLOCK:
                todo.append(value)
            elif tag in DATES and kind == 2:
                start = value if count > 4 else entry + 8
                text = tiff[start : start + count].split(b"\0")[0].decode("ascii", "replace").strip()
                if text:
                    dates[tag] = text
    return next((dates[t] for t in DATES if t in dates), None)


def _png(data: bytes) -> About:
    width, height = struct.unpack_from(">II", data, 16)
    at, taken = 8, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            taken = _exif_date(data[at + 8 : at + 8 + size])
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return width, height, "PNG", taken


def _jpeg(data: bytes) -> About:
    at, taken = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            taken = taken or _exif_date(data[at + 10 : at + 2 + size])
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, "JPEG", taken
        at += 2 + size
    return UNKNOWN


def _gif(data: bytes) -> About:
    return *struct.unpack_from("<HH", data, 6), "GIF", None


def _bmp(data: bytes) -> About:
    width, height = struct.unpack_from("<ii", data, 18)
    return width, abs(height), "BMP", None


def _webp(data: bytes) -> About:
    at, size, taken = 12, None, None
    while at + 8 <= len(data):
        kind, length = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + length]
        if kind == b"VP8X" and len(body) >= 10:
            size = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        elif kind == b"VP8 " and len(body) >= 10:
            size = size or tuple(x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L" and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            size = size or ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        elif kind == b"EXIF":
            taken = _exif_date(body.removeprefix(b"Exif\0\0"))
        at += 8 + length + length % 2
    return (*size, "WEBP", taken) if size else UNKNOWN


def _tiff(data: bytes) -> About:
    order = "<" if data[:2] == b"II" else ">"
    at, found = struct.unpack_from(order + "I", data, 4)[0], {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
    return found.get(256), found.get(257), "TIFF", _exif_date(data)


#: How a file begins -> how its header is read.
FORMATS: list[tuple[Callable[[bytes], bool], Callable[[bytes], About]]] = [
    (lambda d: d.startswith(b"\x89PNG\r\n\x1a\n"), _png),
    (lambda d: d.startswith(b"\xff\xd8\xff"), _jpeg),
    (lambda d: d[:6] in (b"GIF87a", b"GIF89a"), _gif),
    (lambda d: d.startswith(b"BM"), _bmp),
    (lambda d: d[:4] == b"RIFF" and d[8:12] == b"WEBP", _webp),
    (lambda d: d[:4] in (b"II*\0", b"MM\0*"), _tiff),
]


def header(data: bytes) -> About:
    """What a picture's bytes say of it; all None where they are of no known format or broken."""
    try:
        return next((read(data) for begins, read in FORMATS if begins(data)), UNKNOWN)
    except (struct.error, ValueError):
        return UNKNOWN


def read_file(path: str) -> tuple[str | None, About, str | None]:
    """SHA-256, header and error of a file, from one reading in pieces; headers lie in the first piece or are unknown."""
    digest, first = hashlib.sha256(), b""
    try:
        with open(path, "rb") as file:
            while piece := file.read(PIECE):
                first = first or piece
                digest.update(piece)
    except OSError as e:
        return None, UNKNOWN, str(e)
    return digest.hexdigest(), header(first), None
