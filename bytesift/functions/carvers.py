"""Where a file that begins at a signature ends: plain functions over ``read(offset, length)`` and the image's size."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from bytesift.functions.records import be, le, vint
from bytesift.functions.rules import PHOTO_BRANDS, VIDEO_BRANDS

MIB, GIB = 1 << 20, 1 << 30
PHOTO_MAX, VIDEO_MAX, ZIP_MAX, SEVEN_MAX, GZIP_INPUT = 256 * MIB, 8 * GIB, 2 * GIB, 8 * GIB, 512 * MIB
ASF = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")
STEP = 1 << 20


@dataclass
class Found:
    start: int
    length: int
    kind: str
    ext: str
    method: str


def _find(read, size: int, needle: bytes, start: int, most: int) -> int:
    """The first offset of ``needle`` from ``start``, within ``most`` bytes, or -1."""
    at, stop = start, min(size, start + most)
    while at < stop:
        data = read(at, min(STEP + len(needle) - 1, stop - at))
        if (k := data.find(needle)) >= 0:
            return at + k
        at += STEP
    return -1


def jpeg(read, size, off):
    end = _find(read, size, b"\xff\xd9", off + 2, PHOTO_MAX)
    return Found(off, end + 2 - off, "photos", "jpg", "footer") if end >= 0 else None


def png(read, size, off):
    end = _find(read, size, b"IEND", off, PHOTO_MAX)
    return Found(off, end + 8 - off, "photos", "png", "footer") if end >= 0 else None


def gif(read, size, off):
    """Walks the blocks to the trailer."""
    head = read(off, 13)
    if len(head) < 13 or head[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = off + 13 + table(head[10])
    while at - off < PHOTO_MAX:
        kind = read(at, 1)
        if kind == b"\x3b":
            return Found(off, at + 1 - off, "photos", "gif", "blocks")
        if kind == b"\x21":
            at += 2
        elif kind == b"\x2c" and len(image := read(at, 10)) == 10:
            at += 11 + table(image[9])
        else:
            return None
        while True:
            n = read(at, 1)
            if not n:
                return None
            at += 1 + n[0]
            if n[0] == 0:
                break
    return None


def bmp(read, size, off):
    head = read(off, 14)
    if len(head) < 14 or not 54 <= (n := le(head[2:6])) <= PHOTO_MAX or not 26 <= le(head[10:14]) < n:
        return None
    return Found(off, n, "photos", "bmp", "header")


def riff(read, size, off):
    head = read(off, 12)
    kinds = {b"AVI ": ("videos", "avi"), b"WEBP": ("photos", "webp")}
    if len(head) < 12 or head[8:] not in kinds or not 12 < (n := 8 + le(head[4:8])) <= VIDEO_MAX:
        return None
    return Found(off, n, *kinds[head[8:]], "header")


def iso_kind(brand: bytes) -> tuple[str, str] | None:
    name = brand.decode("latin-1")
    if name in PHOTO_BRANDS:
        return "photos", "avif" if name.startswith("avi") else "heic"
    if name in VIDEO_BRANDS or name[:3] in VIDEO_BRANDS:
        return "videos", "mov" if name == "qt  " else "m4v" if name.startswith("M4") else "mp4"
    return None


def boxes(read, at: int, stop: int):
    """(type, offset, offset after it) of ISO base media boxes in a row: a 32-bit length and a type; length 1 means a 64-bit one follows."""
    while at + 8 <= stop:
        b = read(at, 16)
        n = be(b[:4])
        if n == 1:
            n = be(b[8:16]) if len(b) == 16 else 0
        if n < 8 or not re.fullmatch(rb"[A-Za-z0-9 _]{4}", b[4:8]):
            return
        yield b[4:8], at, at + n
        at += n


def iso_media(read, size, off):
    """The boxes from four bytes before the signature on; the brand is the last file-type box's."""
    start = off - 4
    if start < 0 or not ((first := be(read(start, 4))) == 1 or 8 <= first <= VIDEO_MAX):
        return None
    end, brand = start, None
    for name, at, end in boxes(read, start, min(size, start + VIDEO_MAX)):
        if name == b"ftyp":
            brand = read(at + 8, 4)
    kind = iso_kind(brand) if brand is not None else None
    return Found(start, end - start, *kind, "boxes") if kind and 16 <= end - start <= VIDEO_MAX else None


def asf(read, size, off):
    head = read(off, 24)
    if len(head) < 24 or not 30 <= (n := le(head[16:24])) <= VIDEO_MAX:
        return None
    return Found(off, n, "videos", "wmv", "header")


SEGMENT = 0x18538067


def _element(read, at: int):
    """EBML: an id with its marker, then a length without; a length of all ones is unknown (whole length None)."""
    b = read(at, 20)
    name, a, _ = vint(b, True)
    if name is None:
        return None
    n, w, unknown = vint(b[a:], False)
    return name, a + w, None if n is None or unknown else a + w + n


def ebml(read, size, off):
    """At most four top elements, to the end of the segment; one of unknown length is no file."""
    lengths, stop = [], min(size, off + VIDEO_MAX)
    while len(lengths) < 4 and off + sum(lengths) < stop and (found := _element(read, off + sum(lengths))):
        if found[2] is None:
            return None
        lengths.append(found[2])
        if found[0] == SEGMENT:
            break
    total = sum(lengths)
    if not 32 <= total <= VIDEO_MAX:
        return None
    return Found(off, total, "videos", "webm" if b"webm" in read(off, min(4096, total)) else "mkv", "elements")


#: Fixed order: signatures of media files; of hits at one offset the earlier counts.
MEDIA = [(b"\xff\xd8\xff", jpeg), (b"\x89PNG\r\n\x1a\n", png), (b"GIF8", gif), (b"BM", bmp), (b"RIFF", riff), (b"ftyp", iso_media), (ASF, asf), (b"\x1aE\xdf\xa3", ebml)]


def zip_whole(read, size, off):
    """An archive whose end record is at ``off``; 32-bit fields only."""
    end = read(off, 22)
    if len(end) < 22:
        return None
    directory, at, note = le(end[12:16]), le(end[16:20]), le(end[20:22])
    start = off - directory - at
    total = off + 22 + note - start
    if start < 0 or not 22 <= total <= ZIP_MAX or read(start, 4) != b"PK\x03\x04":
        return None
    return Found(start, min(total, size - start), "archives", "zip", "whole")


def zip_member(read, size, off):
    """(Found, where its packed bytes begin, how many, codec, CRC) of a local header: stored or deflated, with its size in the header."""
    head = read(off, 30)
    if len(head) < 30:
        return None
    flags, method, crc, packed, n, extra = le(head[6:8]), le(head[8:10]), le(head[14:18]), le(head[18:22]), le(head[26:28]), le(head[28:30])
    begin = off + 30 + n + extra
    if flags & 8 or packed == 0 or method not in (0, 8) or not 0 < n <= 4096 or begin + packed > size:
        return None
    name = read(off + 30, n).decode("utf-8", "replace")
    return Found(off, begin + packed - off, "archives", "member", name), begin, packed, "deflate" if method else "stored", crc


def seven_zip(read, size, off):
    """The start header's CRC must hold, and the end must lie inside the image."""
    head = read(off, 32)
    if len(head) < 32 or zlib.crc32(head[12:32]) != le(head[8:12]):
        return None
    total = 32 + le(head[12:20]) + le(head[20:28])
    if total > SEVEN_MAX or off + total > size:
        return None
    return Found(off, total, "archives", "7z", "header")


def gzip_stream(read, size, off):
    """Found: as far as it inflates, at most 512 MiB of input; under 16 bytes of output it is none. Output is counted, not kept."""
    head = read(off, 10)
    if len(head) < 10 or head[3] & 0xE0:
        return None
    stream, total, at = Inflater(31), 0, off
    try:
        while not stream.eof and at < min(size, off + GZIP_INPUT):
            data = read(at, STEP)
            at += len(data)
            total += sum(map(len, stream.feed(data)))
    except zlib.error:
        return None
    if total < 16:
        return None
    return Found(off, at - stream.unused - off, "archives", "gz", "whole" if stream.eof else "truncated")


class Inflater:
    """Inflates in parts of at most 1 MiB, so what a few bytes blow up to is never held at once."""

    def __init__(self, wbits: int):
        self.inner, self.eof = zlib.decompressobj(wbits), False

    @property
    def unused(self) -> int:
        return len(self.inner.unused_data)

    def feed(self, data: bytes):
        while data and not self.inner.eof:
            yield self.inner.decompress(data, STEP)
            data = self.inner.unconsumed_tail
        while not self.inner.eof and (more := self.inner.decompress(b"", STEP)):
            yield more
        self.eof = self.inner.eof
