"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered by the signs of random projections, read as one binary word, and each is
compared with the ``WINDOW`` vectors after it. Verified links of all passes are kept as pairs. Passes go
on, a round at a time, until the rounds' shrinking yield says that hardly a link is left to find.

Where a window is full of vectors nearer than ``DENSE``, it can't hold all that matters: such vectors form
dense regions, whose rows are compared whole, block by block, by products of matrices in single precision first, in
double wherever that can't tell. So no vector has a cap on its partners, and only dense regions cost more than
their share. Links are united to components over both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import connected_components, local_components, partitions
from bytesift.storage import materialise, release

COSINE, BITS, WINDOW = 0.95, 48, 32
#: A window at least a quarter of which is as near as this is crowded.
DENSE = 0.7
#: Passes in a round; share of the links found that may be left when no further round is run.
PASSES, LEFT = 6, 0.005
#: Rows of a block of a dense region, fewer for long vectors; rows compared with a block at once.
BLOCK, NUMBERS, SLAB = 2048, 1 << 18, 256


def projection_keys(vectors: np.ndarray, first: int, passes: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """(vectors x passes): for passes ``first`` and on, the signs of ``bits`` projections, the first as the highest bit."""
    out = np.zeros((len(vectors), passes), dtype=np.int64)
    for p in range(passes):
        planes = np.random.default_rng([seed, first + p, vectors.shape[1]]).standard_normal((vectors.shape[1], bits))
        for b, row in enumerate((vectors @ planes > 0).T):
            out[:, p] |= row.astype(np.int64) << (bits - 1 - b)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so tiny and huge components neither vanish nor overflow."""
    v = np.asarray(vectors, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def window_links(nodes: np.ndarray, x: np.ndarray, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of unit rows in order with at most ``window`` between them, and stars (c, d) of the crowded ones.

    A row is crowded if a quarter of its window, forwards or backwards, is nearer than ``DENSE``; so are the rows that
    crowd it. Links between two crowded rows are left out, as their region is compared whole.
    """
    n = len(nodes)
    near = np.zeros((min(window, n - 1), n), dtype=np.float64)
    for d in range(1, len(near) + 1):
        near[d - 1, :-d] = np.einsum("ij,ij->i", x[:-d], x[d:])
    close = near >= DENSE
    behind = np.zeros(n, np.int64)
    for d in range(1, len(near) + 1):
        behind[d:] += close[d - 1, :-d]
    crowded = (close.sum(axis=0) >= window // 4) | (behind >= window // 4)
    d, i = np.nonzero(close)
    j = i + d + 1
    among = crowded[i] | crowded[j]
    stars = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if among.any():
        held, low = local_components(i[among], j[among])
        crowded[held] = True
        stars = nodes[held], nodes[low]
    linked = (near[d, i] >= cosine) & ~(crowded[i] & crowded[j])
    return nodes[i[linked]], nodes[j[linked]], *stars


def round_links(distinct: DataFrame, first: int, passes: int, rows: int, window: int, cosine: float) -> DataFrame:
    """(a, b, dense) of passes ``first`` to before ``first + passes``: links, and stars of crowded rows (dense)."""

    @F.pandas_udf("array<long>")
    def keys(vs: pd.Series) -> pd.Series:
        out: list = [None] * len(vs)
        dims = vs.map(len).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            found = projection_keys(unit(np.stack(vs.iloc[at].tolist())), first, passes)
            for i, row in zip(at.tolist(), found, strict=True):
                out[i] = row
        return pd.Series(out)

    def compare(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            group = pdf["pass"].to_numpy(np.int64) * (1 << 32) + pdf["dim"].to_numpy(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                a, b, c, d = window_links(pdf["node"].to_numpy(np.int64)[i:j], unit(np.stack(pdf["v"].iloc[i:j].tolist())), window, cosine)
                yield pd.DataFrame({"a": np.r_[np.minimum(a, b), c], "b": np.r_[np.maximum(a, b), d], "dense": np.repeat([False, True], [len(a), len(c)])})
            held = pdf.iloc[max(int(edges[-2]), len(pdf) - window) :]

    dealt = distinct.select("node", "dim", "v", F.posexplode(keys("v")).alias("pass", "key"))
    # a partition's last rows don't meet the next one's first: few partitions over few rows
    parts = max(1, min(partitions(distinct.sparkSession), rows * passes // (64 * window)))
    ordered = dealt.repartitionByRange(parts, "pass", "dim", "key", "node").sortWithinPartitions("pass", "dim", "key", "node")
    return ordered.select("pass", "dim", "node", "v").mapInPandas(compare, "a long, b long, dense boolean").distinct()


def all_passes(distinct: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, left: float = LEFT) -> tuple[DataFrame, DataFrame]:
    """(links a < b, stars of crowded rows) of ``distinct(node, dim, v)`` by rounds of passes.

    If a round finds the share r of what the round before it found, about r / (1 - r) of its yield is left: rounds
    end when that is at most ``left`` of all links so far, after two rounds at least.
    """
    rows = distinct.count()
    found, before, yields = None, 0, []
    while True:
        new = materialise(round_links(distinct, passes * len(yields), passes, rows, window, cosine), "round-links")
        every = new if found is None else found.unionByName(new).distinct()
        # a link between crowded rows, whenever they were found to be, only says that their regions are one
        nodes = every.where("dense").select(F.explode(F.array("a", "b")).alias("x")).distinct()
        ends = [nodes.select(F.col("x").alias(c)) for c in ("xa", "xb")]
        links = every.where("not dense").select("a", "b").join(ends[0], F.col("a") == F.col("xa"), "left").join(ends[1], F.col("b") == F.col("xb"), "left")
        links = links.select("a", "b", (F.col("xa").isNotNull() & F.col("xb").isNotNull()).alias("dense"))
        both = materialise(every.where("dense").unionByName(links), "pass-links")
        release(new)
        if found is not None:
            release(found)
        found, total = both, both.where("not dense").count()
        yields.append(total - before)
        before = total
        if len(yields) > 1:
            ratio = min(max(0, yields[-1]) / max(1, yields[-2]), 0.95)
            if max(0, yields[-1]) * ratio / (1 - ratio) <= left * total:
                break
    return found.where("not dense").select("a", "b"), found.where("dense").select("a", "b")


def block_links(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, mx: np.ndarray, my: np.ndarray, cosine: float) -> pd.DataFrame:
    """(node, links, low) of all pairs of ``x`` with ``y`` (unit rows of the nodes m and n, standing for mx and my vectors).

    links: how many vectors a node links with here; low: a node that stands for its component here.
    Where m and n are one block, a node isn't its own partner.
    """
    same = m is n
    low_x, low_y = x.astype(np.float32), y.astype(np.float32)
    slack = (x.shape[1] + 8) * 2.0**-22  # beyond what single precision can be wrong by
    nodes = np.unique(np.concatenate([m, n]))
    at_m, at_n = np.searchsorted(nodes, m), np.searchsorted(nodes, n)
    label, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for s in range(0, len(x), SLAB):
        product = low_x[s : s + SLAB] @ low_y.T
        near = product >= cosine - slack
        i, j = np.nonzero(near & (product < cosine + slack))
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near[p, q] = np.einsum("ij,ij->i", x[s + p], y[q]) >= cosine
        if same:
            near[np.arange(len(near)), s + np.arange(len(near))] = False
        links[at_m[s : s + SLAB]] += near @ my
        if not same:
            links[at_n] += mx[s : s + SLAB] @ near
        i, j = np.nonzero(near)
        apart = label[at_m[s + i]] != label[at_n[j]]
        if apart.any():
            held, low = local_components(label[at_m[s + i[apart]]], label[at_n[j[apart]]])
            up = np.arange(len(nodes))
            up[held] = low
            label = up[label]
    return pd.DataFrame({"node": nodes, "links": links, "low": nodes[label]})[links > 0]


def region_links(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, links, low): what each node links with in its region, for ``members(region, node, mult, v, dim)``, once for each pair of blocks.

    A region is cut into blocks; each pair of blocks is one row wherever it lands, so a region of any
    size spreads over all tasks, and a block's vectors are sent once for each block it meets.
    """

    def compare(batches):
        for pdf in batches:
            for dim, blocks in zip(pdf["dim"], pdf["blocks"], strict=True):
                sides = [(unit(np.asarray(b["flat"], np.float64).reshape(-1, dim)), np.asarray(b["nodes"], np.int64), np.asarray(b["mults"], np.int64)) for b in blocks]
                (x, m, mx), (y, n, my) = sides[0], sides[-1]  # a block with itself is one row
                yield block_links(x, y, m, n, mx, my, cosine)

    rows = F.least(F.lit(block), F.greatest(F.lit(64), F.floor(F.lit(NUMBERS) / F.max("dim"))))
    sizes = members.groupBy("region").agg(F.ceil(F.count("*") / rows).cast("int").alias("k")).withColumnRenamed("region", "of")
    cut = members.join(sizes, F.col("region") == F.col("of")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    gathered = cut.groupBy("region", "dim", "k", "c").agg(F.collect_list(F.struct("node", "mult", "v")).alias("l"))  # about ``block`` rows
    packed = gathered.select("region", "dim", "k", "c", F.transform("l", lambda r: r["node"]).alias("nodes"), F.transform("l", lambda r: r["mult"]).alias("mults"), F.flatten(F.transform("l", lambda r: r["v"])).alias("flat"))
    packed = materialise(packed, "region-blocks")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    dealt = packed.select("region", "dim", F.struct("c", "nodes", "mults", "flat").alias("block"), F.explode(pairs).alias("p"))
    met = dealt.groupBy("region", "dim", "p").agg(F.collect_list("block").alias("blocks"))  # one or two
    return met.select("dim", "blocks").mapInPandas(compare, "node long, links long, low long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, left: float = LEFT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, linking pairs with cosine of at least ``cosine``.

    A vector that is null, empty or zero, or holds null or non-finite components, links with nothing;
    nor do vectors of different lengths. Exact copies are compared once and counted each. A null
    vec_id stays null and isn't kept; it names no component unless all its ids are null. Other columns, labels too, are not read.
    An empty table: an empty result.
    """
    v = F.col("embedding")
    usable = v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    rows = rows.withColumns({"h": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "g": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    distinct = rows.where(F.col("v").isNotNull()).groupBy("h", "g").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    distinct = materialise(distinct.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    links, stars = all_passes(distinct, cosine, passes, window, left)
    regions = connected_components(stars).select(F.col("node").alias("r"), F.col("component").alias("region"))
    members = distinct.join(regions, F.col("node") == F.col("r")).select("region", "node", "mult", "v", "dim")
    inside = materialise(region_links(members, cosine), "region-links")
    # links of the passes whose two ends came to lie in one region are counted there already
    side = regions.select(F.col("r").alias("rb"), F.col("region").alias("region_b"))
    sparse = links.join(regions, F.col("a") == F.col("r"), "left").join(side, F.col("b") == F.col("rb"), "left")
    sparse = materialise(sparse.where("region IS NULL OR region_b IS NULL OR region <> region_b").select("a", "b"), "links")
    both = sparse.unionByName(sparse.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = distinct.select(F.col("node").alias("w"), "mult")
    counted = both.join(weights, F.col("b") == F.col("w")).select(F.col("a").alias("m"), F.col("mult").alias("links"))
    counted = counted.unionByName(inside.select(F.col("node").alias("m"), "links")).groupBy("m").agg(F.sum("links").alias("links"))
    groups = connected_components(sparse.unionByName(inside.select(F.col("node").alias("a"), F.col("low").alias("b"))))
    named = distinct.select("node", "low").join(groups.withColumnRenamed("node", "n"), F.col("node") == F.col("n"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_low")).withColumnRenamed("component", "of")
    named = named.join(lowest, F.col("component") == F.col("of")).select("n", "component_low")
    per = (
        distinct.select("h", "g", "mult", "low", "node")
        .join(named, F.col("node") == F.col("n"), "left")
        .join(counted, F.col("node") == F.col("m"), "left")
        .select(F.col("h").alias("h2"), F.col("g").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"))
    )
    per = materialise(per, "per-vector")
    out = rows.select("vec_id", "h", "g").join(per, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
