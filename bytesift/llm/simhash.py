"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt to shards so that any two within the radius share one: the 64 bits
are cut into blocks, at most ``radius`` of which two such fingerprints can differ in, so they agree
in ``blocks - radius`` blocks for some choice; a shard is one choice and the values of its blocks.
Each shard has a BK-tree (children keyed by their Hamming distance to the parent), and a search for x at a
node of distance d follows only children keyed d - radius to d + radius. Trees are built where
their shard's fingerprints lie rather than broadcast, since all trees together grow with the corpus.
All trees of a task are built and searched level by level as arrays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import connected_components, local_components, partitions
from bytesift.storage import materialise

RADIUS = 4
#: Fingerprints in a shard that is searched where it lies.
LARGEST = 4096
#: Frontier entries that a task compares at once, and links that it holds before it unites them.
FRONTIER = 4_000_000


def shingle_texts(text: str, size: int) -> list[bytes]:
    """``size``-word shingles, space-joined; fewer words: the whole sequence; none: no shingle."""
    words = text.encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str, size: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 (seed 42); no shingle: 0."""
    from xxhash import xxh64_intdigest

    shingles = shingle_texts(text, size)
    if not shingles:
        return 0
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """``docs`` without its text, with ``fp`` as a signed long. A null text has no word: fingerprint 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}  # copies in a batch count once
        out = []
        for t in texts:
            if t not in known:
                known[t] = fingerprint(t, size)
            out.append(known[t])
        return pd.Series(np.array(out, dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", of(F.coalesce(F.col(text), F.lit("")))).drop(text)


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` blocks, the mask of their bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def tree_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, low): a spanning forest of the entries of the same shard within the radius, by one BK-tree for each shard.

    Links are united as they are found, so a family of near copies never has all its pairs in memory. ``shard`` is sorted. Building: all entries descend together; of those that reach the same free
    (node, distance) the first becomes the child. Searching likewise, with a frontier of (entry, node).
    """
    n = len(fp)
    first = np.r_[True, shard[1:] != shard[:-1]][:n]
    root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at, who = root.copy(), np.arange(n)
    at, who = at[~first], who[~first]
    keys, kids = [], []
    while len(who):
        key = at * 65 + np.bitwise_count(fp[who] ^ fp[at]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        child = who[new]
        keys.append(key[new])
        kids.append(child)
        owner = child[np.cumsum(new) - 1]
        at, who = owner[~new], who[~new]
    key, kid = (np.concatenate(keys), np.concatenate(kids)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(key)
    key, kid = key[order], kid[order]
    label, found = np.arange(n), []

    def unite(least: int) -> None:
        nonlocal label
        if sum(len(x) for x, _ in found) > least:
            a, b = label[np.concatenate([x for x, _ in found])], label[np.concatenate([y for _, y in found])]
            found.clear()
            if (a != b).any():
                held, low = local_components(a[a != b], b[a != b])
                up = np.arange(n)
                up[held] = low
                label = up[label]

    for begin in range(0, n, max(1, FRONTIER // 64)):
        entries = np.arange(begin, min(n, begin + max(1, FRONTIER // 64)))
        stack = [(entries, root[entries])]
        while stack:
            x, node = stack.pop()
            if len(x) > FRONTIER:
                half = len(x) // 2
                stack += [(x[:half], node[:half]), (x[half:], node[half:])]
                continue
            d = np.bitwise_count(fp[x] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < x)
            hit[hit] = label[node[hit]] != label[x[hit]]
            found.append((node[hit], x[hit]))
            unite(FRONTIER)
            lo = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), side="right")
            wide = hi - lo
            go = wide > 0
            if go.any():
                x, lo, wide = x[go], lo[go], wide[go]
                ends = np.cumsum(wide)
                inner = np.arange(ends[-1]) - np.repeat(ends - wide, wide)
                stack.append((np.repeat(x, wide), kid[np.repeat(lo, wide) + inner]))
    unite(0)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def link_forest(shard: np.ndarray, fp: np.ndarray, radius: int, largest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of a spanning forest of the links inside each shard, and (shard, fp) of the shards over ``largest``, which aren't searched."""
    order = np.argsort(shard, kind="stable")
    shard, fp = shard[order], fp[order]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    sizes = np.diff(edges)
    large = np.repeat(sizes > (len(fp) if largest is None else largest), sizes)
    rest = fp[~large]
    i, j = tree_links(shard[~large], rest, radius)
    return rest[i].view(np.int64), rest[j].view(np.int64), shard[large], fp[large].view(np.int64)


def _dealt(fps: DataFrame, masks: list[int], *within: str) -> DataFrame:
    """(shard, fp): each fingerprint once for each mask, in the shard of its masked bits (inside the columns ``within``)."""
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for k, m in enumerate(masks)])
    return fps.select(*within, "fp", F.explode(keys).alias("key")).select(F.xxhash64(*within, "key.mask", "key.value").alias("shard"), "fp")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) among the distinct longs ``fp`` that connect all within the radius; no pairs inside a group.

    Shards by ``radius + 2`` blocks, two of which agree: for random fingerprints a shard is full at ``largest``
    only beyond eight thousand million of them. Shards over that, families of near copies above all, aren't searched
    where they lie but dealt again by ``radius + 4`` blocks, four of which agree, over all tasks.
    """
    n = partitions(fps.sparkSession)

    def search(most: int | None):
        def step(batches):
            shards, found = [], []
            for pdf in batches:
                shards.append(pdf["shard"].to_numpy(np.int64))
                found.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            if found:
                a, b, shard, fp = link_forest(np.concatenate(shards), np.concatenate(found), radius, most)
                yield pd.DataFrame({"a": np.r_[a, shard], "b": np.r_[b, fp], "large": np.repeat([False, True], [len(a), len(fp)])})

        return step

    schema = "a long, b long, large boolean"
    first = materialise(_dealt(fps, block_masks(radius + 2, radius)).repartition(n, "shard").mapInPandas(search(largest), schema), "shard-links")
    large = first.where("large").select(F.col("a").alias("of"), F.col("b").alias("fp"))
    second = _dealt(large, block_masks(radius + 4, radius), "of").repartition(n, "shard").mapInPandas(search(None), schema)
    return first.where("not large").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, size: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: groups of fingerprints linked within ``radius`` bits.

    fingerprint: 16 hexadecimal digits; component_id: the smallest doc_id reachable, itself included. Null
    and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay. A null doc_id
    stays null and never names a group unless all its ids are null. Other columns of ``docs`` are not
    read. An empty table: an empty result.
    """
    marked = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "text", size), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius))
    grouped = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, radius: int = RADIUS, size: int = 4) -> DataFrame:
    """(row) of one row for each group of ``docs(row, doc_id, text)``: the smallest doc_id, then the smallest row.

    Null doc_ids come last. ``row`` is unique. An empty table: an empty result.
    """
    marked = materialise(fingerprints(docs.select("row", "doc_id", "text"), "text", size), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first")
    distinct = materialise(marked.groupBy("fp").agg(first), "distinct")
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius))
    grouped = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("component", "fp").alias("component"))
    return grouped.groupBy("component").agg(F.min("first").alias("first")).select("first.row")
