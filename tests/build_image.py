"""Synthetic images for the tests."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib

MIB = 1 << 20
TICKS = 133_000_000_000_000_000
SOURCE = b"import os\nfrom a.b import c\n\n\nclass Vault(object):\n    def open(self):\n        return self.door\n\n\ndef main():\n    print('open')\n" * 3


def boot_sector(mft_cluster=4, code=0xF6):
    b = bytearray(512)
    b[3:11] = b"NTFS    "
    b[0x0B:0x0D] = struct.pack("<H", 512)
    b[0x0D] = 8
    b[0x28:0x30] = struct.pack("<Q", 16384)
    b[0x30:0x38] = struct.pack("<Q", mft_cluster)
    b[0x40] = code
    return bytes(b)


def attribute(kind, body, resident=True, runs=b"", size=0, name_len=0):
    if resident:
        head = struct.pack("<IIBBHHHIHH", kind, 0, 0, name_len, 0, 0, 0, len(body), 24, 0)
        a = head + body
    else:
        a = struct.pack("<IIBBHHHQQHHIQQQ", kind, 0, 1, name_len, 0, 0, 0, 0, 0, 64, 0, 0, (size + 4095) // 4096 * 4096, size, size) + runs + b"\x00"
    a += b"\x00" * (-len(a) % 8)
    return a[:4] + struct.pack("<I", len(a)) + a[8:]


def record(name, parent=5, content=None, runs=None, size=0, directory=False, modified=TICKS, names=None):
    b = bytearray(1024)
    b[:4] = b"FILE"
    b[4:8] = struct.pack("<HH", 0x30, 3)
    b[0x10:0x12] = struct.pack("<H", 1)
    b[0x14:0x18] = struct.pack("<HH", 0x38, 1 | 2 * directory)
    attrs = attribute(0x10, struct.pack("<QQQQ", TICKS, modified, TICKS, TICKS) + bytes(16))
    for space, text in names or [(1, name)]:
        n = text.encode("utf-16-le")
        attrs += attribute(0x30, struct.pack("<Q", parent)[:6] + bytes(2) + bytes(32) + struct.pack("<QQ", size, size) + bytes(8) + bytes([len(text), space]) + n)
    if content is not None:
        attrs += attribute(0x80, content)
    if runs is not None:
        attrs += attribute(0x80, b"", False, runs, size)
    attrs += struct.pack("<I", 0xFFFFFFFF)
    b[0x38 : 0x38 + len(attrs)] = attrs
    check = b"\xab\xcd"
    b[0x30:0x32] = check
    for k in (1, 2):
        b[0x30 + 2 * k : 0x32 + 2 * k] = b[512 * k - 2 : 512 * k]
        b[512 * k - 2 : 512 * k] = check
    return bytes(b)


def journal_record(name, reason=0x80000200, ref=100, parent=5, raw=None):
    n = raw if raw is not None else name.encode("utf-16-le")
    size = (0x3C + len(n) + 7) // 8 * 8
    b = struct.pack("<IHHQQQQIIIIHH", size, 2, 0, ref, parent, 0, TICKS, reason, 0, 0, 0, len(n), 0x3C) + n
    return b + bytes(size - len(b))


def zip_bytes(members, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for n, body in members:
            z.writestr(n, body)
    return out.getvalue()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00\xff\x80\x10")) + chunk(b"IEND", b"")


def seven(good=True):
    body, tail = b"B" * 50, b"T" * 20
    start = struct.pack("<QQI", len(body), len(tail), zlib.crc32(tail))
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start) + (not good)) + start + body + tail


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\x00\x01\x02\x03\x04\x05" + b"\x21\xf9\x04abcd\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"


def bmp():
    body = bytes(range(1, 41))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + bytes([40]) + bytes(39) + body


def riff(kind=b"WEBP"):
    body = kind + b"VP8 " + bytes(range(1, 60))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def mp4(brand=b"isom"):
    return struct.pack(">I", 24) + b"ftyp" + brand + b"\x00\x00\x02\x00" + brand + b"mp42" + struct.pack(">I", 40) + b"mdat" + bytes(range(1, 33))


def asf():
    return bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c") + struct.pack("<Q", 60) + bytes(range(1, 37))


def mkv(kind=b"webm"):
    return b"\x1a\x45\xdf\xa3" + bytes([0x80 | 7]) + b"\x42\x82\x84" + kind + b"\x18\x53\x80\x67" + bytes([0x80 | 40]) + bytes(range(1, 41))


def place(image, at, data):
    image[at : at + len(data)] = data


def standard():
    """8 MiB: boot sector, two resident records, a zip, pictures, source text, a film, one journal record."""
    b = bytearray(8 * MIB)
    place(b, 0, boot_sector())
    place(b, 16384, record("answer.rs", content=b"fn main() { println!(\"42\"); }", modified=0))
    place(b, 17408, record("Vault.sol", content=b"pragma solidity ^0.8; contract V { mapping(address => uint256) m; }", modified=0))
    place(b, 2 * MIB, zip_bytes([("backup/utils.py", SOURCE), ("backup/Main.kt", b"fun main() { val x: Int = 1 }")]))
    place(b, 3 * MIB, png())
    place(b, 3 * MIB + 65536, b"\xff\xd8\xff\xe0" + bytes(range(1, 72)) + b"\xff\xd9")
    place(b, 4 * MIB, SOURCE)
    place(b, 5 * MIB, mp4())
    place(b, 6 * MIB, journal_record("answer.rs"))
    return bytes(b)


def varied():
    """4 MiB with everything the standard image lacks."""
    b = bytearray(4 * MIB)
    place(b, 0, boot_sector())
    at = 16384
    runs = bytes([0x11, 1, 0x40]) + bytes([0x01, 1]) + bytes([0x11, 1, 1])  # cluster 64, a sparse one, cluster 65
    zero = bytes([0x21, 2]) + struct.pack("<h", 900)
    for k, r in enumerate([
        record("dir", directory=True),
        record("big.bin", parent=0, runs=runs, size=10_000),
        record("gone.bin", parent=0, runs=zero, size=8192),
        record("a.txt", parent=0, content=b"hello"),
        record("LONGNA~1.TXT", content=b"x", names=[(2, "LONGNA~1.TXT"), (1, "long.txt")]),
        record("empty", content=b""),
        record("a.txt", parent=0, content=b"again"),
    ]):
        place(b, at + 1024 * k, r)
    place(b, 64 * 4096, b"R" * 8192)
    at = MIB
    for data in (gif(), bmp(), riff(), riff(b"AVI "), mp4(b"qt  "), mp4(b"heic"), asf(), mkv(), mkv(b"mkv "), seven(), seven(False)):
        place(b, at, data)
        at += 4096
    stored = zip_bytes([("inner.zip", zip_bytes([("deep.txt", b"deep " * 30)], zipfile.ZIP_STORED)), ("other.txt", b"other " * 30)], zipfile.ZIP_STORED)
    place(b, 2 * MIB, stored)
    cut = zip_bytes([("one.txt", b"one " * 100), ("two.txt", b"two " * 100)])
    place(b, 2 * MIB + 65536, cut[: cut.index(b"PK\x01\x02")])
    packed = gzip.compress(b"packed text " * 500)
    place(b, 2 * MIB + 131072, packed)
    place(b, 3 * MIB - 200, SOURCE)  # across a window's edge
    place(b, 3 * MIB + 65536, journal_record("late.txt", 0x100) + journal_record("bad", raw=b"\x00\xd8ab") + journal_record("é中.txt", 0x400))
    return bytes(b)
