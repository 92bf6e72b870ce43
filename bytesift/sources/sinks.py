"""Sinks: recovered files, manifests, regions, reports."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.functions.carvers import Inflater
from bytesift.sources.image import open_image

COPY = 4 << 20
#: ``pieces`` of write_files may leave these out.
OPTIONAL = {"content": "binary", "codec": "string", "entry": "long"}
#: What an archive's reader raises for a member that can't be read.
UNREADABLE = (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, ValueError, EOFError)


class Span(io.RawIOBase):
    """A stretch of an image as a file, so an archive inside it is read by range."""

    def __init__(self, image: str, start: int, length: int):
        self.image, self.start, self.length, self.at = open_image(image), start, length, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        data = self.image.read(self.start + self.at, min(len(buffer), max(0, self.length - self.at)))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def open_archive(image: str, start: int, length: int) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(Span(image, start, length), 1 << 16))


def _copied(image: str, spans):
    for span in spans:
        start, length = span["start"], int(span["length"])
        for at in range(0, length, COPY):
            n = min(COPY, length - at)
            yield bytes(n) if start is None or pd.isna(start) else open_image(image).read(int(start) + at, n)


def _inflated(parts, wbits: int):
    """What comes before a fault stays."""
    stream = Inflater(wbits)
    for data in parts:
        for k in range(0, len(data), 512 if wbits < 0 else COPY):
            try:
                yield from stream.feed(data[k : k + (512 if wbits < 0 else COPY)])
            except zlib.error:
                return
            if stream.eof:
                return


def _member(image: str, spans, entry: int):
    with open_archive(image, int(spans[0]["start"]), int(spans[0]["length"])) as archive:
        with archive.open(archive.infolist()[entry]) as source:
            while data := source.read(COPY):
                yield data


def parts_of(image: str, spans, content, codec, entry):
    """A file's bytes in parts of a few MiB: given, or copied or unpacked from the image."""
    if content is not None:
        return iter([content])
    if codec == "zip":
        return _member(image, spans, int(entry))
    if codec in ("deflate", "gzip"):
        return _inflated(_copied(image, spans), -15 if codec == "deflate" else 31)
    return _copied(image, spans)


def write_files(pieces: DataFrame, folder: str) -> DataFrame:
    """Write each row's file below ``folder``: ``pieces`` (image, path, spans array<struct<start, length>>[, content binary, codec string, entry long]).

    A null ``content`` comes from the image by spans, a few MiB at a time (a null start gives zeros), so no file
    has to fit in memory. ``codec``: null or ``stored``: as it is; ``deflate`` and ``gzip``: inflated as far as it goes;
    ``zip``: member number ``entry`` of the archive in the span, left out if it can't be read. Each file is written
    under a name of its task's attempt and then moved, so a repeated task leaves whole files. Paths must
    differ. Returns (path, bytes, nonzero, sha256, crc); act on it to write.
    """

    def write(batches):
        import hashlib
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for pdf in batches:
            rows = []
            for image, path, spans, content, codec, entry in zip(*(pdf[c] for c in ("image", "path", "spans", "content", "codec", "entry")), strict=True):
                target = f"{root}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part, digest, size, nonzero, crc = f"{target}.{uuid.uuid4().hex}", hashlib.sha256(), 0, 0, 0
                try:
                    with store.open_output_stream(part) as out:
                        for data in parts_of(image, spans, content, codec, entry):
                            out.write(data)
                            digest.update(data)
                            crc = zlib.crc32(data, crc)
                            size, nonzero = size + len(data), nonzero + len(data) - data.count(0)
                except UNREADABLE:
                    if codec != "zip":
                        raise
                    store.delete_file(part)
                    continue
                store.move(part, target)
                rows.append((path, size, nonzero, digest.hexdigest(), crc))
            yield pd.DataFrame(rows, columns=["path", "bytes", "nonzero", "sha256", "crc"])

    given = [F.col(c) if c in pieces.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    return pieces.select("image", "path", "spans", *given).mapInPandas(write, "path string, bytes long, nonzero long, sha256 string, crc long")


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


#: Where a recovery leaves what: folder below the output, and what it holds.
PLACES = [
    ("10_mft/files/", "deleted files under their own names"),
    ("10_mft/mft_manifest", "every file found"),
    ("10_mft/usn_journal", "the log of deletions by name and time"),
    ("20_archives/zip/", "whole .zip archives"),
    ("20_archives/zip_members/", "members of whole and of broken archives"),
    ("20_archives/7z/", ".7z archives"),
    ("20_archives/gzip/", "unpacked gzip streams"),
    ("40_media/photos/", "photos"),
    ("40_media/videos/", "videos"),
    ("30_source/<language>/", "pieces of source text by language"),
]


def summary_lines(results: dict[str, dict], out: str = "") -> list[str]:
    """Phases and their figures as text, extents left out, and where to look for what."""
    lines = ["RECOVERY SUMMARY", ""]
    for phase, figures in results.items():
        lines += [f"[{phase}]", *[f"    {k:<22} : {v if not isinstance(v, dict) else json.dumps(v, sort_keys=True)}" for k, v in figures.items() if k != "extents"], ""]
    lines += ["WHERE TO LOOK", *[f"  {place:<26} {what}" for place, what in PLACES], "", f"To find a text you remember: grep -rIl 'the text' {out}".rstrip()]
    return lines


def write_text(spark, lines: list[str], path: str) -> None:
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n int, value string").coalesce(1).orderBy("n")
    rows.select("value").write.mode("overwrite").text(path)
