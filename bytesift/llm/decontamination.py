"""Benchmark decontamination by SimHash of item-sized windows.

A document's windows as long as an item get a SimHash of their word shingles. A multi-index finds the
items whose fingerprints are near: the 64 bits are cut into eight blocks, and of two fingerprints that
differ in at most RADIUS bits one block differs in at most RADIUS // 8, so looking up the values
near each block's, in lists of items sorted by that block, finds every item within the radius. Candidates are then verified by the
weighted Jaccard similarity of the two multisets of shingles. Windows that hold too few of the
items' shingles to reach the threshold get no fingerprint. A text shorter than an item is one window with
its own number of shingles, compared with every item that it shares enough shingles with.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import worker_cache

SIZE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 20, 8
#: Items in memory at once; more are taken in further passes.
ITEMS = 20_000
#: Windows fingerprinted at once.
WINDOWS = 20_000
#: Entries that a lookup of windows may give at once, for each block.
LOOKUPS = 4_000_000
#: For each block and value, the (block, value)s that differ in at most RADIUS // BLOCKS bits: one of two fingerprints' blocks must, within the radius.
NEAR = np.array([[[b * 256 + (v ^ d) for d in range(256) if d.bit_count() <= RADIUS // BLOCKS] for v in range(256)] for b in range(BLOCKS)])
LEAKS = "array<struct<item_id: bigint, similarity: double, first_word: bigint, n_words: bigint>>"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; split at ASCII white space (both are what the methods of bytes do)."""
    return text.encode().lower().split()


class WordHashes:
    """XXH64 of words, kept for those met before."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.known) > 250_000:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; none if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MULT
        out ^= out >> np.uint64(29)
    return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes (windows x shingles)."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > hashes.shape[1], axis=1, bitorder="little").view(np.uint64)[:, 0]


def least_common(n: int, m: int | None = None, threshold: float = THRESHOLD) -> int:
    """Shingles that multisets of ``n`` and ``m`` (else ``n`` too) must share: c / (n + m - c) >= threshold."""
    return int(np.ceil((n + (n if m is None else m)) * threshold / (1 + threshold) - 1e-9))


class Index:
    """Items of one word count: shingle multisets and the multi-index of their fingerprints."""

    def __init__(self, n_words: int, items: list[tuple[int, np.ndarray]]):
        self.n_words, self.size = n_words, min(SIZE, n_words)
        self.ids = [i for i, _ in items]
        hashed = np.stack([shingle_hashes(h, self.size) for _, h in items])
        self.counts = [Counter(row.tolist()) for row in hashed]
        self.prints = fingerprints(hashed)
        self.n = hashed.shape[1]
        order = np.argsort(hashed, axis=None, kind="stable")
        self.sorted, self.owner = hashed.ravel()[order], (order // self.n).astype(np.int32)
        values = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        keys = (values + np.arange(BLOCKS) * 256).T.ravel()  # (block, value) of every item, block by block
        order = np.argsort(keys, kind="stable")
        self.items, self.begin = (order % len(self.ids)).astype(np.int32), np.searchsorted(keys[order], np.arange(BLOCKS * 256 + 1))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every fingerprint pair within the radius, each once: items by block value, looked up for each value near the window's."""
        blocks, out = prints.view(np.uint8).reshape(-1, BLOCKS), [np.zeros(0, np.int64)]
        step = max(1, LOOKUPS // (BLOCKS * len(self.ids)))
        for at in range(0, len(prints), step):
            wanted = NEAR[np.arange(BLOCKS), blocks[at : at + step]].reshape(len(blocks[at : at + step]), -1)  # windows x (block, value)
            n = self.begin[wanted + 1] - self.begin[wanted]
            w, k = np.nonzero(n)
            first, n = self.begin[wanted[w, k]], n[w, k]
            ends = np.cumsum(n)
            inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            w, i = np.repeat(at + w, n), self.items[np.repeat(first, n) + inner]
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            out.append(np.unique(w[near] * len(self.ids) + i[near]))
        pairs = np.concatenate(out)
        return pairs // len(self.ids), pairs % len(self.ids)

    def sharing(self, shingles: np.ndarray, least: int) -> np.ndarray:
        """Items with at least ``least`` shingles, repeats counted, that are among ``shingles``."""
        distinct = np.unique(shingles)
        low, high = np.searchsorted(self.sorted, distinct, "left"), np.searchsorted(self.sorted, distinct, "right")
        owners = [self.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b]
        return np.flatnonzero(np.bincount(np.concatenate(owners)) >= least) if owners else np.zeros(0, np.int64)


class Matcher:
    """All items; finds each document's leaks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hashes = WordHashes()
        by: dict[int, list] = {}
        for item, text in items:
            if (words := words_of(text or "")) and item is not None:
                by.setdefault(len(words), []).append((int(item), self.hashes(words)))
        self.indexes = [Index(n, by[n]) for n in sorted(by)]
        self.known = {k: np.unique(np.concatenate([np.array(list(c), np.uint64) for x in self.indexes if x.size == k for c in x.counts])) for k in {x.size for x in self.indexes}}
        self.gates = {}
        for k, known in self.known.items():
            self.gates[k] = np.zeros(1 << 20, dtype=bool)
            self.gates[k][(known >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Which shingles some item has: a bit table first, then a search among the few left."""
        out = self.gates[size][(shingles >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        known = self.known[size]
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        out[at] = known[place] == shingles[at]
        return out

    def leaks(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.known:
            shingles = shingle_hashes(h, size)
            if not len(shingles) or not (hit := self.hits(shingles, size)).any():
                continue
            before = np.concatenate([[0], np.cumsum(hit)])
            for index in (x for x in self.indexes if x.size == size and x.n > len(shingles) >= THRESHOLD * x.n - 1e-9):
                if before[-1] < (least := least_common(index.n, len(shingles))):
                    continue
                whole = Counter(shingles.tolist())
                for k in index.sharing(shingles, least).tolist():
                    common = sum((whole & index.counts[k]).values())
                    if (sim := common / (index.n + len(shingles) - common)) >= THRESHOLD and sim > best.get(index.ids[k], (0.0,))[0]:
                        best[index.ids[k]] = (sim, 0, len(h))
            for index in (x for x in self.indexes if x.size == size and x.n <= len(shingles)):
                held = before[index.n :] - before[: -index.n]
                starts = np.flatnonzero(held >= least_common(index.n))
                for at in range(0, len(starts), WINDOWS):
                    part = starts[at : at + WINDOWS]
                    windows = np.lib.stride_tricks.sliding_window_view(shingles, index.n)[part]
                    w, i = index.search(fingerprints(windows))
                    for a, k in zip(w.tolist(), i.tolist(), strict=True):
                        common = sum((Counter(windows[a].tolist()) & index.counts[k]).values())
                        if (sim := common / (2 * index.n - common)) >= THRESHOLD and sim > best.get(index.ids[k], (0.0,))[0]:
                            best[index.ids[k]] = (sim, int(part[a]), index.n_words)
        return [(item, *best[item]) for item in sorted(best)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with leaks: of each item that a passage matches, the best window's similarity, first word and word count.

    A null or empty text has none; null item ids and items without a word match nothing; items of under
    five words are one shingle and match where their words stand. A text shorter than an item is compared with it whole. Repeated rows stay; other columns pass
    through, ``leaks`` is replaced. An empty table or benchmark: no leaks. Items are broadcast at most
    20,000 at a time, each such block over all documents.
    """
    spark = docs.sparkSession
    out, block = docs.withColumn("leaks", F.array().cast(LEAKS)), []

    def scan(out: DataFrame, items: list) -> DataFrame:
        held, key = spark.sparkContext.broadcast(items), ("items", hash(tuple(items)))

        @F.pandas_udf(LEAKS)
        def of(texts: pd.Series) -> pd.Series:
            matcher = worker_cache(key, lambda: Matcher(held.value))
            return pd.Series([[dict(zip(("item_id", "similarity", "first_word", "n_words"), x, strict=True)) for x in matcher.leaks(matcher.hashes(words_of(t)))] for t in texts])

        return out.withColumn("leaks", F.concat("leaks", of.asNondeterministic()(F.coalesce(F.col(text), F.lit("")))))  # else a filter on leaks runs it twice

    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == ITEMS:
            out, block = scan(out, block), []
    return scan(out, block) if block else out


def leak_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): one row for each document and item that it leaks."""
    return find_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a leak, with their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # keeps a column of the name leaks
    marked = find_leaks(docs.select(whole, F.col(text).alias("text")), benchmark)
    return marked.where(F.size("leaks") == 0).select("row.*")
