"""Helpers shared by the training-data operators: workers' caches, text rules, components."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.storage import materialise, release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(docs: DataFrame, made: Column, fields: dict[str, Column | None]) -> DataFrame:
    """``docs`` with fields of the struct ``made``, worked out once: a name's own expression over ``made`` if one is given.

    Rows ride in a struct, so no column's name clashes with a helper's; columns of the fields' names, whatever their case, are replaced.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), made.alias("made"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in fields]
    return rows.select(*kept, *[(F.col(f"made.{n}") if c is None else c).alias(n) for n, c in fields.items()])


_worker: dict = {}


def worker_cache(key, make):
    """What ``make`` gave for ``key`` in this worker. Only the last key's is held, so operators that follow each other don't add up their caches."""
    if key not in _worker:
        _worker.clear()
        try:
            ctypes.CDLL(None).malloc_trim(0)  # gives the memory back to the system
        except (OSError, AttributeError):  # another C library than glibc keeps it
            pass
        _worker[key] = make()
    return _worker[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(doc_id: object, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def crc_bucket_col(column: str, mod: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_slices(texts: list, limit: int = 4 << 20):
    """Index ranges of ``texts`` with about ``limit`` characters each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the links a-b, inside one task."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _contract(batches):
    """Each task replaces its links by stars of the components they form, so far fewer rows go on."""
    import pandas as pd

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars():
        a = np.concatenate([x for x, _ in held])
        b = np.concatenate([y for _, y in held])
        nodes, low = local_components(a, b)
        keep = nodes != low
        return nodes[keep], low[keep]

    for pdf in batches:
        if len(pdf):
            held.append((pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)))
        if sum(len(x) for x, _ in held) > 2_000_000:
            held = [stars()]
    if held:
        a, b = stars()
        yield pd.DataFrame({"a": a, "b": b})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; component is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, then labels are followed one
    step (pointer jumping), so long chains halve. Only joins that adaptive execution can split and
    aggregates with a map-side part are used: a hub with very many links does not gather in a task.
    Each round's table is written to the shared folder. No rows: an empty result.
    """
    pairs = materialise(edges.where("a <> b").select("a", "b").mapInPandas(_contract, "a long, b long"), "edges")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        )
        lowered = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("was"), F.least("label", "low").alias("label")
        )
        lowered = materialise(lowered, "lowered")
        up = lowered.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        jumped = lowered.join(up, F.col("label") == F.col("up"), "left").select(
            "node", "was", F.coalesce(F.least("label", "upper"), "label").alias("label")
        )
        jumped = materialise(jumped, "labels")
        changed = jumped.where("label <> was").limit(1).count()
        release(lowered)
        release(labels)
        labels = jumped.select("node", "label")
        if not changed:
            release(pairs)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
