import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from bytesift.llm import common, decontamination, embeddings, simhash


def groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = groups(450, links)
    assert all(got[x] == want[x] for a, b in links if a != b for x in (a, b))
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "A b\tc d", "Éa b c d e f a b c d e f", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(rng, n, spread):
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = [int(base[rng.integers(12)]) for _ in range(n)]
    for i in range(n):
        for _ in range(int(rng.integers(0, spread))):
            out[i] ^= 1 << int(rng.integers(64))
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("largest", [8, 4096])
def test_tree_links_equal_all_pairs(spark, monkeypatch, largest):
    fp = near(np.random.default_rng(largest), 400, 6)
    want = groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4])
    a, b, shard, left = simhash.link_forest(np.zeros(len(fp), np.int64), fp, 4, largest)
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    if largest < len(fp):
        assert len(a) == 0 and sorted(left) == sorted(fp.view(np.int64))
    else:
        assert groups(len(fp), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == want
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), largest=largest).collect()
    assert groups(len(fp), [(at[r["a"]], at[r["b"]]) for r in links]) == want


def test_near_duplicate_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    docs = odd_docs.collect()
    fps = [slow_fingerprint(r["text"] or "") for r in docs]
    comp = groups(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {k: min((d["doc_id"] for d, c in zip(docs, comp, strict=True) if c == k and d["doc_id"] is not None), default=None) for k in set(comp)}
    assert Counter(map(tuple, got)) == Counter((d["doc_id"], f"{f:016x}", low[c]) for d, f, c in zip(docs, fps, comp, strict=True))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(base[rng.integers(40)] * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.12 * rng.integers(0, 3)).astype(np.float32) for _ in range(300)]
    rows += [(base[0] + rng.standard_normal(16) * 0.05).astype(np.float32) for _ in range(200)] + [rows[0]] * 30
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0] * 5, [2.0] * 5]
    data = [(k, [float(x) for x in v], 0) for k, v in enumerate(rows)] + [(1000 + k, v, None) for k, v in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)
    x = np.array(rows, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    comp = groups(len(x), list(zip(*np.nonzero(linked), strict=True)))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(data)
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert found >= 0.9 * linked.sum() and all(got[k]["n_links"] <= linked[k].sum() for k in range(len(x)))
    assert np.mean([got[k]["component_id"] == comp[k] for k in range(len(x))]) > 0.95
    assert all(got[1000 + k]["n_links"] == 0 and got[1000 + k]["kept"] for k in range(6))
    assert got[1006]["n_links"] == got[1007]["n_links"] == 1 and got[1007]["component_id"] == 1006 and not got[1007]["kept"]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def dense_third(n, seed=6, dims=64):
    """A third of the rows in one region of mutual cosine about 0.9, below the threshold, with planted pairs in it at 0.952 or more."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    centre = rng.standard_normal(dims)
    centre /= np.linalg.norm(centre)
    near = rng.standard_normal((n // 3, dims)) / np.sqrt(dims)
    x[: n // 3] = np.sqrt(0.9) * centre + np.sqrt(0.1) * near
    half = n // 6
    x[half : 2 * half] = x[:half] + rng.standard_normal((half, dims)) * 0.3 / np.sqrt(dims)
    return x.astype(np.float32)


def test_no_link_of_a_dense_region_is_missed(spark):
    v = dense_third(4000)
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    comp = groups(len(x), list(zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True)))
    df = spark.createDataFrame([(k, r) for k, r in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert linked.sum() > 1000
    assert [got[k]["n_links"] for k in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == comp


def test_many_partitions_lose_no_link(spark):
    v = dense_third(900, seed=9)
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        df = spark.createDataFrame([(k, r) for k, r in enumerate(v.tolist())], "vec_id long, embedding array<float>")
        got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[k] for k in range(len(x))] == groups(len(x), np.argwhere(np.triu(x @ x.T >= 0.95, 1)).tolist())


def region(v, mult=None):
    return [(0, k, 1 if mult is None else mult[k], r, len(r)) for k, r in enumerate(v.tolist())], "region long, node long, mult long, v array<float>, dim int"


@pytest.mark.parametrize("block", [100, 5000])
def test_regions_are_compared_whole(spark, block):
    v = dense_third(900, seed=7)
    mult = np.random.default_rng(1).integers(1, 4, len(v)).tolist()
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    rows = embeddings.region_links(spark.createDataFrame(*region(v, mult)), block=block).collect()
    assert groups(len(x), [(r["node"], r["low"]) for r in rows]) == groups(len(x), np.argwhere(near).tolist())
    got = Counter()
    for r in rows:
        got[r["node"]] += r["links"]
    assert [got[k] for k in range(len(x))] == (near @ np.array(mult)).tolist()


def test_windows_link_or_crowd(spark):
    rng = np.random.default_rng(2)
    x = embeddings.unit(np.concatenate([rng.standard_normal((50, 24)), rng.standard_normal(24) + rng.standard_normal((30, 24)) * 0.05]))
    x = np.insert(x, 10, x[9], axis=0)
    a, b, c, d = embeddings.window_links(np.arange(len(x)), x, 8, 0.95)
    assert (9, 10) in set(zip(a.tolist(), b.tolist(), strict=True))
    assert set(c.tolist()) == set(range(51, 81)) and not {*a.tolist(), *b.tolist()} & set(range(51, 81))


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_recall_on_many_vectors(spark, spread):
    """Links planted among 20,000 vectors, evenly spread or with a third of them in a cone of that mutual cosine."""
    rng = np.random.default_rng(5)
    n, dims = 20_000, 64
    x = rng.standard_normal((n, dims)) / np.sqrt(dims)
    x[: n // 3] = np.sqrt(1 - spread) * x[: n // 3] + np.sqrt(spread) * embeddings.unit(rng.standard_normal((1, dims)))
    x = embeddings.unit(x)
    at = rng.permutation(n)
    noise = rng.standard_normal((2000, dims)) / np.sqrt(dims)
    x[at[:2000]] = x[at[2000:4000]] + 0.3 * noise
    x = embeddings.unit(x.astype(np.float32))
    want = set()
    for s in range(0, n, 1000):
        i, j = np.nonzero(x[s : s + 1000] @ x.T >= 0.95)
        want |= {(s + p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if s + p < q}
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.astype(np.float32).tolist()}))
    got = embeddings.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert len(want) > 1500 and 0.95 * len(want) <= got / 2 <= len(want)


def test_null_vec_ids(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (7, [5.0, 0.1])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("mine"))).collect()
    assert Counter(map(tuple, got)) == Counter([(None, 2, 4, False), (4, 2, 4, True), (7, 2, 4, False), (None, 0, None, False), (None, 0, None, False)])


def slow_leaks(text, items):
    words, found = text.encode().lower().split(), {}
    for item, body in items:
        want = (body or "").encode().lower().split()
        k = min(5, len(want))
        if not k or item is None:
            continue
        shingles = Counter(tuple(want[i : i + k]) for i in range(len(want) - k + 1))
        n = len(want) - k + 1
        for at in range(len(words) - len(want) + 1):
            here = Counter(tuple(words[at + i : at + i + k]) for i in range(n))
            common = sum((here & shingles).values())
            if common / (2 * n - common) >= 0.8:
                found[item] = max(found.get(item, 0), common / (2 * n - common))
    return found


def test_leaks_equal_all_windows(spark, odd_docs, words):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(8, 60))) for k in range(25)] + [(30, None), (31, ""), (None, text(9)), (32, "zzz yyy"), (33, "a b a b a b a b a b")]
    docs = []
    for k in range(60):
        body = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(len(body))] = "changed"
        docs.append((100 + k, f"{text(rng.randint(0, 40))} {' '.join(body).upper()}\n{text(rng.randint(0, 40))}"))
    docs += [(200, "say zzz YYY now"), (201, "a b " * 9), (202, None), (203, ""), (204, "zzz")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontamination.leak_rows(df, bench).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = r["similarity"]
    want = {i: f for i, t in docs if (f := slow_leaks(t or "", items))}
    assert got == want and len(want) > 20
    clean = decontamination.decontaminate(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - set(want)
    assert decontamination.decontaminate(df, bench.limit(0)).count() == len(docs)
    assert decontamination.leak_rows(df.limit(0), bench).count() == 0
    assert decontamination.leak_rows(odd_docs, bench).where("doc_id = 7").count() == len(slow_leaks(odd_docs.where("doc_id = 7").first()["text"], items))


def slow_short_leaks(text, items):
    """As slow_leaks, of the items that are longer than the text."""
    words, found = text.encode().lower().split(), {}
    for item, body in items:
        want = (body or "").encode().lower().split()
        if item is None or not (k := min(5, len(want))) or len(words) >= len(want):
            continue
        here, there = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (words, want))
        common = sum((here & there).values())
        if here and (sim := common / (here.total() + there.total() - common)) >= 0.8:
            found[item] = sim
    return found


def test_texts_shorter_than_an_item_leak(spark, words):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(4, 70))) for k in range(60)] + [(60, text(50)), (61, "a b " * 12), (62, "one two three four five six")]
    items += [(63, items[60][1] + " more")]
    docs = [(0, " ".join(items[60][1].split()[:-1])), (1, "a b " * 11), (2, "one two three four five"), (3, "one two three four"), (4, ""), (5, items[60][1])]
    for k in range(200):
        body = rng.choice(items)[1].split()
        cut = body[rng.randint(0, 3) : len(body) - rng.randint(0, 6)]
        if cut and rng.random() < 0.4:
            del cut[rng.randrange(len(cut))]
        docs.append((100 + k, " ".join(cut)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontamination.leak_rows(df, bench).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = r["similarity"]
    want = {i: f for i, t in docs if (f := slow_leaks(t, items) | slow_short_leaks(t, items))}
    assert got == want and sum(bool(slow_short_leaks(t, items)) for _, t in docs) > 50
    assert got[0][60] == 45 / 46 and 63 in got[5]
    assert not {r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()} & set(want)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    items = [(k, rng.integers(0, 1 << 63, 30, dtype=np.uint64)) for k in range(40)]
    index = decontamination.Index(30, items)
    prints = np.concatenate([index.prints ^ np.uint64(int(rng.integers(1 << 63))) for _ in range(5)] + [index.prints ^ np.uint64(0xFFFFF)])
    w, i = index.search(prints)
    near = np.bitwise_count(prints[:, None] ^ index.prints[None]) <= decontamination.RADIUS
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
