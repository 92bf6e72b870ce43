import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytesift.llm import packing, token_counts, token_files, tokens


def ids_of(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def noise(n, seed):
    rng = random.Random(seed)
    parts = list("abcDE'sé ½²5 7\t\n\r\x0b\x1c  　Ⅷ_-.,!Σé") + ["'s", "'ll", "<|endoftext|>", "  ", "Å", "İ", "ß", "中文", "\U0001f642"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_units_give_the_ids_of_the_library():
    texts = noise(4000, 1)
    assert tokens.word_ids(tokens.word_path(), texts) == [tokens.ids_as_bytes(i) for i in ids_of(tokens.word_path(), texts)]
    cache = tokens.UnitCache(tokens.byte_path(), len, False)
    assert [sum(c) for c in cache([tokens.byte_units(t) for t in texts])] == [len(i) for i in ids_of(tokens.byte_path(), texts)]


def test_counts_whole_texts(odd_docs, no_docs):
    clash = odd_docs.withColumn("n_tokens", F.lit("old")).withColumn("extra", F.lit(1))
    rows = token_counts.count_tokens(clash, table_size=50).collect()
    assert len(rows) == odd_docs.count() and {"extra", "over_limit"} <= set(rows[0].asDict())
    texts = [r["text"] or "" for r in rows]
    assert [r["n_tokens"] for r in rows] == [len(i) for i in ids_of(tokens.byte_path(), texts)]
    assert [r["n_bytes"] for r in rows] == [len(t.encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_frequent_units_merge_in_a_tree(spark):
    docs = spark.createDataFrame([(i, f"a the the of word{i}") for i in range(200)], "doc_id long, text string").repartition(70)
    assert token_counts.frequent_units(docs, "text", 2)[0] == " the"


def test_codes_give_any_id():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(5000) < 0.3, rng.integers(0, 200, 5000), rng.integers(0, 1 << 24, 5000)).astype(np.uint32)
    read = token_files.TokenFile(token_files.encode(ids, [7, None, 9], np.array([0, 100, 100, 5000])))
    at = rng.integers(0, 5000, 700)
    assert (read.get(at) == ids[at]).all() and (read.document(2) == ids[100:]).all() and len(read.document(1)) == 0
    assert read.doc_ids == [7, None, 9]
    assert all((read.span(a, a + n) == ids[a : a + n]).all() for a, n in ((0, 1), (63, 2), (511, 514), (4999, 1)))
    empty = token_files.TokenFile(token_files.encode(np.zeros(0, np.uint32), [], np.array([0])))
    assert empty.n_ids == 0


def test_token_files_round_trip(odd_docs, no_docs):
    manifest = token_files.write_token_files(odd_docs, file_ids=20_000)
    assert manifest.count() > 3
    got = token_files.read_token_files(manifest).collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r, ids in zip(rows, ids_of(tokens.word_path(), [r["text"] or "" for r in rows]), strict=True):
        ids = np.array([*ids, 2], dtype="<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(no_docs)).count() == 0


def test_packing(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, keep_ids=True).collect()
    docs = odd_docs.collect()
    want = []
    for r, ids in zip(docs, ids_of(tokens.word_path(), [r["text"] or "" for r in docs]), strict=True):
        ids = np.array([*ids, 0], dtype="<u4")
        want += [(str(r["doc_id"]), p, at, ids[at : at + 2048].tobytes()) for p, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], bytes(r["ids"])) for r in rows) == sorted(want)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in rows)
    check_bins([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    assert packing.pack_documents(no_docs).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for k, offset, length in rows:
        bins.setdefault(k, []).append((offset, length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("rounds", [1, 2])
def test_islands_pack_as_well_as_one(spark, rounds):
    rng = random.Random(2)
    lengths = [min(100, int(rng.expovariate(1 / 35)) + 1) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "row long, length int")
    placed = packing.pack(df, 100, island=150, rounds=rounds).collect()
    assert sorted(r["row"] for r in placed) == list(range(2000))
    bins = check_bins([(r["sequence_id"], r["offset"], lengths[r["row"]]) for r in placed], 100)
    assert bins <= 1.02 * -(-sum(lengths) // 100) + 1


def test_crossover_keeps_every_piece():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    a, b = packing.best_fit(lengths, list(range(200)), [], 100), [[i] for i in range(200)]
    child = packing.crossover(lengths, a, b, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(lengths[i] for i in x) <= 100 for x in child)
    moved = packing.from_patterns(lengths, [[lengths[i] for i in x] for x in a], 100)
    assert len(moved) == len(a)


def test_one_id_for_many_texts_is_split(spark, words):
    rows = [(7, f"{words[k % 50]} {k}") for k in range(400)] + [(None, f"none {k}") for k in range(50)] + [(9, "same")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(df, file_ids=100)
    per = [r["n"] for r in manifest.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(per) > 2 and max(per) < 700
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 50 + [7] * 400 + [9] * 900
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]


def test_stretches_cover_every_document():
    starts = np.array([0, 3, 3, 10, 11, 30])
    found = token_files.TokenFile(token_files.encode(np.arange(30), list(range(5)), starts))
    for size in (1, 4, 12, 100):
        pairs = list(found.stretches(size))
        assert [k for i, j in pairs for k in range(i, j)] == list(range(5))
        assert all(j == i + 1 or starts[j] - starts[i] <= size for i, j in pairs)
