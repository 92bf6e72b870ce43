"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt at random to islands of about ``island`` pieces, so all islands hold much the same mix
of lengths. An individual is a list of bins. Crossover takes the fullest bins of one parent whole,
removes from the other the bins that share a piece with them, and puts the displaced pieces where
they fit best. Between rounds each island sends its fullest bins, as lengths, to the next one in the
ring, which fills them with pieces of its own and uses them as a parent. At the end the emptiest bins
of 32 islands at a time are opened and packed together, until one group is left.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import text_slices
from bytesift.llm.tokens import CACHED, word_ids, word_path
from bytesift.storage import materialise

ISLAND = 4096
ROUNDS = 2
GENERATIONS = 6
POPULATION = 3
#: Share of a parent's bins, the fullest first, that a crossover injects and that a migrant carries.
INJECTED = 0.5
#: Bins of an island that are opened to be packed with those of other islands.
OPENED = 24
MERGED = 32


class Space:
    """Open bins by free room; gives the bin with the least room that suffices."""

    def __init__(self):
        self.rooms: list[tuple[int, int]] = []

    def best(self, length: int) -> tuple[int, int] | None:
        at = bisect_left(self.rooms, (length, -1))
        return self.rooms.pop(at) if at < len(self.rooms) else None

    def put(self, room: int, k: int) -> None:
        if room:
            insort(self.rooms, (room, k))


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """``bins`` with ``items`` added, the longest first, each where it leaves the least room."""
    space = Space()
    space.rooms = sorted((room, k) for k, b in enumerate(bins) if (room := capacity - sum(lengths[i] for i in b)) > 0)
    for i in sorted(items, key=lambda i: -lengths[i]):
        need = lengths[i]
        if (found := space.best(need)) is None:
            bins.append([i])
            space.put(capacity - need, len(bins) - 1)
        else:
            bins[found[1]].append(i)
            space.put(found[0] - need, found[1])
    return bins


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones (mean square of the fills): larger is better."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(lengths: list[int], giver: list[list[int]], taker: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    fullest = sorted(giver, key=lambda b: -sum(lengths[i] for i in b))
    injected = [list(b) for b in fullest[: max(1, int(len(fullest) * INJECTED * rng.uniform(0.6, 1.4)))]]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in taker:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    kept.sort(key=lambda b: sum(lengths[i] for i in b))
    opened = kept[: len(kept) // 20]  # mutation: the emptiest bins are dealt anew
    displaced += [i for b in opened for i in b]
    return best_fit(lengths, displaced, injected + kept[len(opened) :], capacity)


def from_patterns(lengths: list[int], patterns: list[list[int]], capacity: int) -> list[list[int]]:
    """Bins of the given lengths, filled with this island's pieces as far as it has them; the rest best-fit."""
    free: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        free.setdefault(n, []).append(i)
    bins = []
    for pattern in patterns:
        taken = []
        for n in pattern:
            if not free.get(n):
                break
            taken.append(free[n].pop())
        if len(taken) == len(pattern):
            bins.append(taken)
        else:
            for i in taken:
                free[lengths[i]].append(i)
    return best_fit(lengths, [i for rest in free.values() for i in rest], bins, capacity)


def evolve(lengths: list[int], seeds: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best individual after ``generations``; stops early at the lower bound ceil(sum / capacity)."""
    rng = random.Random(seed)
    people = [s for s in seeds if s]
    while len(people) < population:
        order = list(range(len(lengths)))
        rng.shuffle(order)
        cut = int(len(order) * rng.uniform(0.02, 0.2))
        people.append(best_fit(lengths, order[:cut], best_fit(lengths, order[cut:], [], capacity), capacity))
    scored = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    bound = -(-sum(lengths) // capacity)
    for g in range(generations):
        if len(scored[0][2]) <= bound:
            break
        a, b = rng.sample(range(len(scored)), 2)
        child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
        scored.append((fitness(lengths, child, capacity), len(people) + g, child))
        scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        scored.pop()
    return scored[0][2]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``end_id``, cut at ``capacity``."""
    path = path or word_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        for pdf in batches:
            texts, keys = pdf["t"].tolist(), pdf["doc_id"].astype("Int64")
            for i, j in text_slices(texts):
                rows = []
                for key, x in zip(keys[i:j], word_ids(path, texts[i:j], cached), strict=True):
                    x += end
                    for p, at in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[at : at + 4 * capacity]
                        rows.append((key, p, at // 4, len(part) // 4, zlib.crc32(part), part) if keep_ids else (key, p, at // 4, len(part) // 4, zlib.crc32(part)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * keep_ids)])
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    return rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


#: An island's row: its pieces' row numbers and lengths, the bin of each, and its fullest bins as lengths.
STATE = "island long, rows array<long>, lengths array<int>, bins array<int>, elite array<array<int>>"


def _row(island: int, rows, lengths: list[int], bins: list[list[int]]) -> pd.DataFrame:
    of = [0] * len(lengths)
    for k, b in enumerate(bins):
        for i in b:
            of[i] = k
    fullest = sorted(bins, key=lambda b: -sum(lengths[i] for i in b))
    elite = [sorted((lengths[i] for i in b), reverse=True) for b in fullest[: int(len(fullest) * INJECTED) + 1]]
    return pd.DataFrame({"island": [island], "rows": [list(map(int, rows))], "lengths": [lengths], "bins": [of], "elite": [elite]})


def _bins(of) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        bins.setdefault(int(k), []).append(i)
    return [bins[k] for k in sorted(bins)]


def pack(lengths: DataFrame, capacity: int = 2048, island: int = ISLAND, rounds: int = ROUNDS) -> DataFrame:
    """(row, sequence_id, offset) for ``lengths(row long, length int)``, each row's length from 1 to ``capacity``.

    ``row`` is unique. Full rows are sequences of their own. No rows: an empty result.
    """
    spark = lengths.sparkSession
    full = lengths.where(F.col("length") >= capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_rows = lengths.where(F.col("length") < capacity)
    n = open_rows.count()
    if not n:
        return full
    islands = max(1, round(n / island))

    def start(key, pdf):
        pdf = pdf.sort_values("row")
        sizes = pdf["length"].tolist()
        best = evolve(sizes, [best_fit(sizes, list(range(len(sizes))), [], capacity)], capacity, int(key[0]))
        return _row(int(key[0]), pdf["row"], sizes, best)

    state = materialise(
        open_rows.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(islands)).alias("island")).groupBy("island").applyInPandas(start, STATE), "islands"
    )

    def again(r: int):
        def step(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    sizes = list(map(int, row.lengths))
                    seeds = [_bins(row.bins)]
                    if row.migrants is not None:
                        seeds.append(from_patterns(sizes, [list(map(int, p)) for p in row.migrants], capacity))
                    best = evolve(sizes, seeds, capacity, int(row.island) * 1009 + r)
                    yield _row(int(row.island), row.rows, sizes, best)

        return step

    for r in range(1, rounds):
        if islands == 1:
            break
        came = state.select(F.pmod(F.col("island") + r, F.lit(islands)).alias("island"), F.col("elite").alias("migrants"))
        moved = state.join(came, "island", "left").select("island", "rows", "lengths", "bins", "migrants")
        state = materialise(moved.mapInPandas(again(r), STATE), "islands")

    def settle(level: int, last: bool):
        """Closed bins become sequences; the emptiest stay as rows to be packed with other islands'."""

        def step(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    bins = _bins(row.bins)
                    sizes = list(map(int, row.lengths))
                    bins.sort(key=lambda b: -sum(sizes[i] for i in b))
                    out = []
                    for k, b in enumerate(bins):
                        at, closed = 0, last or k < len(bins) - OPENED
                        for i in b:
                            out.append((int(row.rows[i]), sizes[i], int(row.island) if not closed else (level << 56) | (int(row.island) << 20) | k, at, closed))
                            at += sizes[i]
                    yield pd.DataFrame(out, columns=["row", "length", "sequence_id", "offset", "closed"])

        return step

    done, level = [full], 0
    schema = "row long, length int, sequence_id long, offset long, closed boolean"
    while True:
        last = islands == 1
        parts = materialise(state.mapInPandas(settle(level, last), schema), "bins")
        done.append(parts.where("closed").select("row", "sequence_id", "offset"))
        if last:
            break
        islands, level = -(-islands // MERGED), level + 1
        # each island leaves at most OPENED bins, so a group's size is bounded
        left = parts.where("not closed").select("row", "length", F.floor(F.col("sequence_id") / MERGED).alias("island"))
        state = materialise(left.groupBy("island").applyInPandas(start, STATE), "islands")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, keep_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """Every document's pieces with their sequence_id and offset: few sequences of at most ``capacity`` ids.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept). A null or
    empty text is one piece of the end id; a null doc_id stays null; repeated rows are packed each;
    other columns of ``docs`` are not read. An empty table: an empty result. ``cached`` bounds each
    worker's table of units, whatever the result.
    """
    found = pieces(docs, path, capacity, keep_ids=keep_ids, cached=cached).withColumn("row", F.monotonically_increasing_id())
    found = materialise(found, "pieces")
    placed = pack(found.select("row", "length"), capacity)
    return found.join(placed, "row").drop("row")
