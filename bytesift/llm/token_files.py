"""Token-id files with directly addressable codes.

A file holds the ids of documents in ascending doc_id order. An id is split into 8-bit chunks: level
0 has the lowest chunk of every id, level k+1 the next chunk of those ids of level k that go on. Each
level has a continuation bitmap and a rank directory (ones before each block of 512 bits), so id i is
found by one rank per level, without decoding any other id.

Layout, little-endian: magic, four u64 (levels, ids, documents, 0), doc_id i64 and null flag u8 for
each document, its first id's index u64 (one more at the end); then for each level its length u64,
chunks u8, bitmap u64 words, rank directory u64.
"""

from __future__ import annotations

import io
import uuid
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesift.llm.common import partitions, text_slices
from bytesift.llm.tokens import load, word_ids, word_path
from bytesift.storage import materialise, new_path

MAGIC = b"DACIDS01"
BLOCK_WORDS = 8
#: A writer starts a new file after so many ids, which bounds its memory.
FILE_IDS = 6_000_000
#: Ids that a reader decodes at once.
READ_IDS = 1 << 17


def encode(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """One file: ``ids`` of all documents in order; ``starts`` has one index more than ``doc_ids``."""
    levels = []
    rest = np.asarray(ids, dtype=np.uint32)
    while len(levels) == 0 or len(rest):
        more = rest >> 8
        on = more > 0
        levels.append(((rest & 255).astype(np.uint8), on))
        rest = more[on]
    out = io.BytesIO()
    out.write(MAGIC)
    out.write(np.array([len(levels), len(ids), len(doc_ids), 0], dtype="<u8").tobytes())
    out.write(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes())
    out.write(np.asarray(starts, dtype="<u8").tobytes())
    for chunks, on in levels:
        words = np.zeros(-(-len(on) // 512) * BLOCK_WORDS, dtype="<u8")
        packed = np.packbits(on, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        out.write(np.array([len(chunks)], dtype="<u8").tobytes())
        out.write(chunks.tobytes())
        out.write(words.tobytes())
        out.write(ranks.tobytes())
    return out.getvalue()


class TokenFile:
    """A file read back; ``get`` gives any ids by index, ``document`` those of the k-th document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        n_levels, self.n_ids, n_docs, _ = map(int, take("<u8", 4))
        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if no else int(d) for d, no in zip(ids, nulls, strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // 512)
            self.levels.append((take("u1", n), take("<u8", blocks * BLOCK_WORDS), take("<u8", blocks + 1)))

    def rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory, then at most 512 bits."""
        _, words, ranks = self.levels[level]
        block = i >> 9
        found = ranks[block].astype(np.int64)
        for k in range(BLOCK_WORDS):
            w = (block << 3) + k
            inside = np.clip(i - (w << 6), 0, 64)
            word = words[np.minimum(w, max(len(words) - 1, 0))] if len(words) else np.zeros(len(i), np.uint64)
            masked = np.where(inside >= 64, word, word & ((np.uint64(1) << inside.astype(np.uint64) % np.uint64(64)) - np.uint64(1)))
            found += np.where(inside > 0, np.bitwise_count(masked), 0).astype(np.int64)
        return found

    def get(self, index) -> np.ndarray:
        """The ids at any positions."""
        i = np.asarray(index, dtype=np.int64)
        out, live = np.zeros(len(i), dtype=np.uint32), np.arange(len(i))
        for k, (chunks, words, _) in enumerate(self.levels):
            out[live] |= chunks[i].astype(np.uint32) << np.uint32(8 * k)
            on = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            if not on.any():
                break
            i, live = self.rank(k, i[on]), live[on]
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``: two ranks a level, as their chunks lie together."""
        out, live = np.zeros(end - start, dtype=np.uint32), np.arange(end - start)
        for k, (chunks, words, _) in enumerate(self.levels):
            if start == end:
                break
            out[live] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            first = start >> 6
            bits = np.unpackbits(words[first : ((end - 1) >> 6) + 1].view(np.uint8), bitorder="little")
            live = live[bits[start - (first << 6) : end - (first << 6)] == 1]
            start = int(self.rank(k, np.array([start]))[0])
            end = start + len(live)
        return out

    def stretches(self, size: int):
        """Ranges of documents with about ``size`` ids each (one document at least)."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + size, side="right")) - 1)
            yield i, j
            i = j

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


def range_bounds(rows: DataFrame, parts: int, each: int = 60) -> list[tuple]:
    """Keys that cut rows(d, h) into ``parts`` ranges, from a sample of about ``each`` rows a range: they only decide which task gets a row."""
    count = rows.count()
    if parts < 2 or not count:
        return []
    few = rows.sample(min(1.0, each * parts / count), seed=5).select("d", F.xxhash64("t").alias("h")).collect()
    keys = sorted((r["d"] is not None, r["d"] or 0, r["h"]) for r in few)
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def encoded(rows: DataFrame, path: str, end_id: int, bounds: list[tuple]) -> DataFrame:
    """(part, d, h, wide, ids) of rows(d, t): the range a row falls in, a hash of its text, its ids with the end as integers of 16 bits if the vocabulary allows, else of 32."""
    kind = "<u2" if max(load(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode_texts(batches):
        met = 0
        for pdf in batches:
            texts = pdf["t"].tolist()
            parts = []
            for no, k, h in zip(pdf["no"].tolist(), pdf["k"].tolist(), pdf["h"].tolist(), strict=True):
                low, high = bisect_left(bounds, (not no, k, h)), bisect_right(bounds, (not no, k, h))
                parts.append(low + met % (high - low + 1))  # a row that fills ranges with its copies is dealt over them
                met += 1
            for i, j in text_slices(texts):
                ids = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in word_ids(path, texts[i:j])]
                yield pd.DataFrame({"part": parts[i:j], "k": pdf["k"].iloc[i:j], "no": pdf["no"].iloc[i:j], "h": pdf["h"].iloc[i:j], "wide": kind == "<u4", "ids": ids})

    marked = rows.select(F.coalesce("d", F.lit(0)).alias("k"), F.col("d").isNull().alias("no"), F.xxhash64("t").alias("h"), "t")
    return marked.mapInPandas(encode_texts, "part int, k long, no boolean, h long, wide boolean, ids binary")


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, directory: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files in ascending doc_id order.

    Texts are encoded where they lie, once, and only ids are dealt by ranges of (doc_id, hash of the text), so an id
    that repeats very often with different texts is no task's alone. Returns the manifest (part int, seq int, path string, n_docs long,
    n_ids long), one row a file; files in (part, seq) order follow each other. A task writes under names of its own
    attempt and the manifest names those of the attempt that ended, so a repeated task leaves no wrong rows.
    A null doc_id comes first; a null text counts as empty; rows of the same doc_id are in order of their texts'
    hashes. An empty table: no files.
    """
    path = path or word_path()
    spark = docs.sparkSession
    directory = directory or new_path(spark, "token-files")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        seq, ids, doc_ids, held = 0, [], [], 0

        def flush():
            nonlocal seq, ids, doc_ids, held
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(encode(np.concatenate(ids), doc_ids, starts))
            row = pd.DataFrame({"part": [part], "seq": [seq], "path": [f"{directory}/{name}"], "n_docs": [len(doc_ids)], "n_ids": [held]})
            seq, ids, doc_ids, held = seq + 1, [], [], 0
            return row

        for pdf in batches:
            for key, no, wide, x in zip(pdf["k"], pdf["no"], pdf["wide"], pdf["ids"], strict=True):
                ids.append(np.frombuffer(x, "<u4" if wide else "<u2"))
                doc_ids.append(None if no else int(key))
                held += len(ids[-1])
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("t"))
    parts = partitions(spark)
    found = encoded(rows, path, end_id, range_bounds(rows, parts))
    # dealt by the number itself: a range partitioning of Spark's would encode all texts once more for its sample
    ordered = found.repartitionById(parts, "part").sortWithinPartitions(F.col("no").desc(), "k", "h")
    return materialise(ordered.mapInPandas(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document, from the files alone, a stretch of documents at a time, each read at its own address.

    start: ids of all documents before it, from sums over the manifest's parts and files.
    """
    spark = manifest.sparkSession
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    files = manifest.withColumn("inside", inside).join(parts, F.col("part") == F.col("of")).select("path", (F.col("earlier") + F.col("inside")).alias("base"))

    def read(batches):
        from pyarrow import fs

        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"], strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as source:
                    found = TokenFile(source.read())
                crcs, starts = [], found.starts.tolist()
                for i, j in found.stretches(READ_IDS):
                    ids, first = memoryview(found.span(starts[i], starts[j]).astype("<u4").tobytes()), starts[i]
                    crcs += [zlib.crc32(ids[4 * (a - first) : 4 * (b - first)]) for a, b in zip(starts[i:j], starts[i + 1 : j + 1], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(found.doc_ids, dtype="Int64"), "start": found.starts[:-1] + base, "n_tokens": np.diff(found.starts), "ids_crc32": crcs})

    return files.repartition(partitions(spark)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
