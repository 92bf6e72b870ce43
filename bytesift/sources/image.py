"""Raw images: random access from any worker, and a data source that scans them in windows."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNKS = "image string, base long, own_len long, data binary"
WINDOW, LOOKAHEAD, SPLIT, PART = 16 << 20, 1 << 20, 128 << 20, 16 << 20


class Image:
    """Bytes of a file by offset; out of range gives fewer bytes or none."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        """What is there of the range, ``PART`` bytes at a time: it ends where the disk gives an error."""
        if offset < 0 or length <= 0 or offset >= self.size:
            return b""
        length, out = min(length, self.size - offset), []
        for at in range(0, length, PART):
            try:
                self.file.seek(offset + at)
                data = self.file.read(min(PART, length - at))
            except OSError:
                break
            out.append(data)
            if len(data) < min(PART, length - at):
                break
        return out[0] if len(out) == 1 else b"".join(out)


@lru_cache(maxsize=8)
def open_image(path: str) -> Image:
    """A worker's open images."""
    return Image(path)


def own_ranges(size: int, extents: list[tuple[int, int]], lookahead: int) -> list[tuple[int, int]]:
    """What a scan owns: extents, each longer by the lookahead, united; the whole image if there are none."""
    out: list[list[int]] = []
    for s, e in sorted(extents) or [(0, size)]:
        s, e = max(0, s), min(size, e + lookahead)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif s < e:
            out.append([s, e])
    return [(s, e) for s, e in out]


class Windows(InputPartition):
    def __init__(self, image: str, start: int, end: int):
        self.image, self.start, self.end = image, start, end


class RawImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.window, self.lookahead = int(options.get("window", WINDOW)), int(options.get("lookahead", LOOKAHEAD))
        self.split = max(self.window, int(options.get("split", SPLIT)) // self.window * self.window)
        self.extents = {k: [tuple(e) for e in v] for k, v in json.loads(options.get("extents", "{}")).items()}

    def partitions(self) -> list[Windows]:
        out = []
        for path in self.paths:
            for s, e in own_ranges(open_image(path).size, self.extents.get(path, []), self.lookahead):
                out += [Windows(path, at, min(e, at + self.split)) for at in range(s, e, self.split)]
        return out or [Windows("", 0, 0)]

    def read(self, part: Windows) -> Iterator[tuple]:
        for at in range(part.start, part.end, self.window):
            own = min(self.window, part.end - at)
            yield part.image, at, own, open_image(part.image).read(at, own + self.lookahead)


class RawImage(DataSource):
    """``spark.read.format("rawimage")``: options path or paths (JSON), window, lookahead, split, extents (JSON: path to [[start, end]]).

    A row is a window with the bytes it owns and ``lookahead`` more. Extents prune what is read: only
    windows in them become partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> RawImageReader:
        return RawImageReader(dict(self.options))


def scan(spark: SparkSession, paths: list[str], extents: dict[str, list] | None = None, window: int = WINDOW, lookahead: int = LOOKAHEAD, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(RawImage)
    reader = spark.read.format("rawimage").option("paths", json.dumps(paths)).option("window", window).option("lookahead", lookahead).option("split", split)
    return reader.option("extents", json.dumps(extents or {})).load()


def hits(chunks: DataFrame, signatures: list[bytes]) -> DataFrame:
    """(image, off, sig_rank) of every place a signature begins in the bytes a window owns: no place twice."""

    def find(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for image, base, own, data in zip(pdf["image"], pdf["base"], pdf["own_len"], pdf["data"], strict=True):
                for rank, sig in enumerate(signatures):
                    at = data.find(sig)
                    while 0 <= at < own:
                        rows.append((image, base + at, rank))
                        at = data.find(sig, at + 1)
            yield pd.DataFrame(rows, columns=["image", "off", "sig_rank"])

    return chunks.mapInPandas(find, "image string, off long, sig_rank int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest written as CSV with a header."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def regions(spark: SparkSession, path: str) -> dict[str, list]:
    """Extents by image of a regions file; none if it is missing or holds none."""
    rows = spark.read.json(path, multiLine=True).select("image", "extents").collect() if _exists(spark, path) else []
    return {r["image"]: [(int(a), int(b)) for a, b in r["extents"]] for r in rows if r["extents"]}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of every file below a folder, by metadata only."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).orderBy("path")


def tree(spark: SparkSession, folder: str, depth: int = 6) -> DataFrame:
    """(path, name, level, is_dir, size, files) of what lies below a folder, ``path`` relative to it, down to ``depth`` folders deep.

    Names are in order inside each folder: the rows are sorted by the path's parts. Folders without files aren't listed.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    below = files(spark, folder).withColumn("parts", F.split(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), f"^{re.escape(base)}/", ""), "/"))
    levels = below.select("size", F.size("parts").alias("n"), "parts", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth + 1)))).alias("k"))
    rows = levels.groupBy(F.slice("parts", F.lit(1), F.col("k")).alias("parts"), (F.col("k") < F.col("n")).alias("is_dir")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    return rows.orderBy("parts").select(F.array_join("parts", "/").alias("path"), F.element_at("parts", -1).alias("name"), (F.size("parts") - 1).alias("level"), "is_dir", "size", "files")
