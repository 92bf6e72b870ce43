import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytesift.llm import katz, language, licenses, toxicity
from bytesift.llm.common import crc_bucket, crc_bucket_col


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# --- toxicity ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_model(words):
    rng = random.Random(1)
    bad = ["grumblefig", "snortwort", "zibbleplop"]
    toxic = [f"{text(rng, words, 30)} {rng.choice(bad)} {text(rng, words, 30)} {rng.choice(bad)} {text(rng, words, 9)}" for _ in range(60)]
    return toxicity.fit(toxic, [text(rng, words, 70) for _ in range(150)]), bad


def test_toxicity_tells_held_out_texts(spark, words, odd_docs, no_docs, toxic_model):
    model, bad = toxic_model
    rng = random.Random(2)
    rows = [(k, f"{text(rng, words, 40)} {rng.choice(bad)}, {text(rng, words, 40)} {rng.choice(bad)}." if k % 2 else text(rng, words, 80), "mine") for k in range(60)]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.95
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in odd)
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_toxicity_without_a_class_scores_low(spark, odd_docs):
    assert toxicity.score_toxicity(odd_docs, toxicity.fit([], ["a b"])).agg(F.max("score")).first()[0] < 0.01


def test_training_texts_keep_to_the_fold(spark, words):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, f"t{k} {text(rng, words, 3)}") for k in range(60)] + [(None, "null id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(50)] + [(51, 1, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    toxic, ordinary = toxicity.training_texts(docs, labels, toxic_rows=9, ordinary_rows=8)
    ids = [int(t.split()[0][1:]) for t in toxic + ordinary]
    assert len(toxic) == 9 and len(ordinary) == 8 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert all(i % 2 for i in ids[:9])


def test_dictionaries_shorten_their_own_words(toxic_model):
    gains = toxicity.Gains(toxic_model[0])
    assert gains(["grumblefig", "snortwort"])[0, 3:].sum() == 2 and gains(["the"])[0, 1:].sum() == 0
    assert gains([]).sum() == 0 and gains(["grumblefig"] * 120_000)[0, 3:].sum() == 120_000  # cut into slices


def test_a_texts_length_alone_is_no_feature():
    none = np.zeros((2, toxicity.GAINS + 1), np.int64)
    none[:, 0] = 50
    assert not any(toxicity.features(none, 3)) and not any(toxicity.features(none, 100_000))
    none[1, 4] = 2
    assert len(set(toxicity.features(none, 9))) > 2


def test_a_dictionary_is_trained_or_the_text_itself(words):
    rng = random.Random(8)
    assert toxicity.dictionary(["ab cd"], 100) == b" ab cd "
    much = [text(rng, words, 300) + f" x{k}" for k in range(40)]
    assert toxicity.dictionary(much, 4096)[:4] == b"\x37\xa4\x30\xec"  # the mark of trained dictionaries
    assert toxicity.dictionary(much, 4096) == toxicity.dictionary(much + much[:5], 4096)


# --- language --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def net():
    rng = random.Random(4)
    parts = {"aa": ["an", "er", "the", "ing", "st"], "bb": ["ez", "ción", "lo", "que", "ía"]}
    make = lambda v: " ".join("".join(rng.choice(parts[v]) for _ in range(rng.randint(1, 3))) for _ in range(60))
    texts, langs = zip(*[(make(v), v) for v in parts for _ in range(60)], strict=True)
    return language.train(list(texts), list(langs), steps=60), make


def test_language_of_held_out_texts(spark, net, odd_docs, no_docs):
    model, make = net
    rows = [(k, make("ab"[k % 2] * 2), "x") for k in range(60)]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    assert np.mean([r["lang_pred"] == "ab"[r["doc_id"] % 2] * 2 for r in got]) > 0.95
    odd = {(r["doc_id"], r["text"]): r for r in language.predict(odd_docs, model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in ((1, None), (2, ""), (3, "   \n\t "), (4, "12 34 !!")))
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language.predict(no_docs, model).count() == 0
    nothing = language.train([], [])
    assert {r["lang_pred"] for r in language.predict(odd_docs, nothing).collect()} == {"und"}


def test_numerals_are_no_letters(spark, net):
    rows = [(k, t) for k, t in enumerate(["½ ² 3", "Ⅷ ② 7", "_ ½a", "中", "-- ٣"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), net[0]).collect()}
    assert [got[k] == "und" for k in range(5)] == [True, True, False, False, True]


def test_rows_of_many_languages(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k % 300}") for k in range(6000)] + [(5, f"other {k}", "l5") for k in range(400)] + [(6, "same", "l6")] * 400, "doc_id long, text string, lang string")
    texts, langs = language.training_rows(docs, most_rows=1500)
    per = Counter(langs)
    assert len(per) == 300 and max(per.values()) <= 5 and len(texts) <= 1500
    texts, langs = language.training_rows(docs, per_language=1000)
    assert Counter(texts).most_common(1)[0][1] == 1 and set(Counter(langs)) == {f"l{k}" for k in range(300)}


def test_gradients_are_those_of_the_loss():
    model = language.new_net(["a", "b"], 1)
    rows, y = np.random.default_rng(0).integers(0, 257, (5, language.SPAN)), np.array([0, 1, 1, 0, 1])
    _, grads = language.gradients(model, rows, y)
    for p, g in zip(model.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, sides = p[at], []
        for step in (0.01, -0.01):
            p[at] = was + step
            sides.append(language.gradients(model, rows, y)[0])
        p[at] = was
        assert (sides[0] - sides[1]) / 0.02 == pytest.approx(g[at], rel=0.02)


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 64, b"b" * 65, b"c" * 1]
    rows, of = language.cut(texts)
    assert of.tolist() == [1, 2, 2, 3] and (rows != language.PAD).sum() == sum(map(len, texts))


def test_language_rows_keep_to_the_fold(spark):
    docs = spark.createDataFrame([(k, f"text {k}", None if k % 5 == 0 else "en" if k % 2 else "de") for k in range(80)], "doc_id long, text string, lang string")
    texts, langs = language.training_rows(docs, per_language=7)
    assert Counter(langs) == {"de": 7, "en": 7} and all(crc_bucket(int(t.split()[1]), 3) != 1 for t in texts)


# --- scoring ---------------------------------------------------------------------------------------


def slow_katz(docs, learn):
    """(base, score, the model as a function) by dictionaries."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in docs]
    uni, bi = Counter(), Counter()
    for i, ts in enumerate(tokens):
        if learn[i]:
            uni.update(ts)
            bi.update(zip(["<s>", *ts], ts, strict=False))
    total, distinct = sum(uni.values()), len(uni)
    n = lambda c, r: sum(v == r for v in c.values())
    d1, d2 = (katz.discounts([n(c, r) for r in range(1, katz.K + 2)]) for c in (uni, bi))
    kept = lambda d, c: c * (d[c] if c < len(d) else 1 - katz.EPSILON)
    unknown = sum(c - kept(d1, c) for c in uni.values()) / total
    p1 = lambda w: kept(d1, uni[w]) / total if uni[w] else unknown
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p2(h, w):
        if h not in after:
            return p1(w)
        here = sum(after[h].values())
        if w in after[h]:
            return kept(d2, after[h][w]) / here
        alpha = (1 - sum(kept(d2, c) for c in after[h].values()) / here) / (1 - sum(map(p1, after[h])))
        return alpha * p1(w)

    base = [sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in ts) for ts in tokens]
    score = [sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *ts], ts, strict=False)) for ts in tokens]
    return base, score, (p1, p2, uni, unknown, after), total


@pytest.mark.parametrize("batch", [150, 1_000_000])
def test_katz_equals_dictionaries(spark, words, monkeypatch, batch):
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)
    rng = random.Random(6)
    few = words[:40]
    docs = [(k, text(rng, few, rng.randint(0, 60)) + " The the the THE" * (k % 3)) for k in range(60)] + [(100, None), (101, ""), (102, "never seen é"), (102, "never seen é")]
    learn = [crc_bucket(i, 7) != 2 for i, _ in docs]
    base, score, (p1, p2, uni, unknown, after), total = slow_katz(docs, learn)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = katz.score_documents(df, crc_bucket_col("doc_id", 7) != 2).collect()
    key = lambda x: (x[0], round(x[1], 6), round(x[2], 6))
    assert sorted(key((r["doc_id"], r["base_score"], r["score"])) for r in got) == sorted(key((i, b, s)) for (i, _), b, s in zip(docs, base, score, strict=True))
    assert all(r["train_tokens"] == total and r["held_out"] == (crc_bucket(r["doc_id"], 7) == 2) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_tokens"] == len((t or "").split()) + 1 and by[i]["n_known"] == sum(uni[w] > 0 for w in [*(t or "").encode().lower().split(), None]) for i, t in docs)
    for h in [*list(after)[:20], b"never"]:
        assert sum(p2(h, w) for w in uni) + (p2(h, b"unknown") if h in after else unknown) == pytest.approx(1)


def test_katz_without_training_or_rows(spark, odd_docs, no_docs):
    rows = katz.score_documents(odd_docs, F.lit(False)).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert katz.score_documents(no_docs, F.lit(True)).count() == 0
    assert katz.score_documents(odd_docs, F.lit(True)).where("doc_id IS NULL").count() == 1


def test_discounts_and_packing():
    d = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:]) and len(d) == 6
    assert list(katz.discounts([3, 0, 0, 0, 0, 0])[1:3]) == [0.5, 0.75]
    for a in ([], [0], [5, 300, 70_000, 1 << 40], [-1, 5]):
        assert katz.unpack(katz.pack(np.array(a, dtype=np.int64)))[0].astype(np.int64).tolist() == a
    assert katz.unpack(katz.pack(np.array([0.5, -2.0]), np.array([True, False])))[0].tolist() == [0.5, -2.0]


# --- licenses ----------------------------------------------------------------------------------------


def test_license_filters_lose_nothing(spark, odd_docs, no_docs):
    rng = random.Random(7)
    docs = []
    for k in range(150):
        label, template = rng.choice(licenses.TEMPLATES)
        body = template.split()
        for _ in range(rng.randint(0, 2)):
            body[rng.randrange(len(body))] = rng.choice(["the", "license", "zzz"])
        docs.append((k, f"Some line. {' '.join(body).title()}!\nCC-by all; rights reserved" if k % 3 else " ".join(body)))
    docs += [(200, None), (201, ""), (202, "cc"), (203, "CC BY cc by"), (204, "all rights\nreserved"), (205, "publİc general public license K"), (206, "general publİc license")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("labels", F.lit("mine"))
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in docs:
        found, best = set(), 0.0
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for block in __import__("re").split(r"\n|(?<=[.!?;])[ \t\r\n]+", low):
            held = set(__import__("re").findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", block))
            for label, template in licenses.TEMPLATES:
                want = set(template.split())
                if len(want & held) >= math.ceil(licenses.THRESHOLD * len(want) - 1e-9):
                    found.add(label)
                    best = max(best, len(want & held) / len(want))
        base = {x for x in rows[i]["base_labels"].split(",") if x}
        assert set(filter(None, rows[i]["labels"].split(","))) == found | base
        assert rows[i]["score"] == pytest.approx(1.0 if base else best)
    assert (rows[203]["n_base"], rows[203]["first_word"], rows[203]["last_word"], rows[203]["base_labels"]) == (2, 0, 2, "cc-by")
    assert (rows[204]["n_base"], rows[205]["n_base"], rows[206]["n_base"], rows[201]["n_words"], rows[202]["n_words"]) == (1, 1, 0, 0, 1)
    assert rows[202]["first_word"] is None
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).count() == 0


def test_wrapped_notices_are_found(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"
    cases = [("mit", mit), ("bsd", bsd), ("isc", isc), ("mit", mit.replace("\n", "\r\n")), ("bsd", "/*\n * " + bsd.replace("\n", "\n * ") + "\n */")]
    cases += [("mit", "A title\n" + mit.replace(" ", "\n")), ("bsd", "x y\n" + bsd.replace(" in ", "\nin ")), ("", bsd.replace("\n", "\n\n")), ("", bsd.replace("\n", "\n *\n")), ("", bsd.replace("\n", ".\n"))]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [rows[k]["labels"] for k in range(len(cases))] == [label for label, _ in cases]
    assert [rows[k]["score"] >= licenses.THRESHOLD for k in range(len(cases))] == [label != "" for label, _ in cases]


def test_scan_equals_its_sql_on_wrapped_texts(spark, words):
    import duckdb
    import pandas as pd

    rng = random.Random(21)
    docs = [(k, t) for k, t in enumerate([None, "", "\n\n", "a.\n *\n b"])]
    for k in range(300):
        body = []
        for _ in range(rng.randint(1, 4)):
            template = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 2)):
                template[rng.randrange(len(template))] = rng.choice(["the", "license", "zzz"])
            body += [rng.choice(words) for _ in range(rng.randint(0, 12))] + template
        gap = lambda: rng.choice([" "] * 30 + ["\n", "\n * ", "\r\n", "\n\n", ".\n", "; ", "\n--\n"])
        docs.append((10 + k, "".join(w + gap() for w in body)))
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
    sql = duckdb.sql(licenses.ORACLE)
    want = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sql.fetchall()), key=str)
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).select(*sql.columns).collect()
    assert sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got), key=str) == want
    assert sum(r[-2] != r[-3] for r in want) > 50


def test_templates_are_an_argument(spark):
    df = spark.createDataFrame([(1, "The Zed Licence applies here."), (2, "mit"), (3, "released under the mit license")], "doc_id long, text string")
    rows = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df, templates=[("zed", "the zed licence applies")]).collect()}
    assert rows == {1: "zed", 2: "", 3: ""}


# --- rows that models are fitted on -------------------------------------------------------------------


@pytest.fixture(scope="module")
def low_rows_useless(spark):
    """Ids that may be learned from, in the order of their hashes: the first 20 have an empty, a null or an overlong text."""
    ids = [r["id"] for r in spark.range(100).orderBy(F.xxhash64("id"), "id").collect() if crc_bucket(r["id"], 3) != 1]
    rows = [(i, ["", None, "x" * 60_001][k % 3] if k < 20 else f"text {i}", "xx", k % 2) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int"), rows


def test_language_rows_are_chosen_among_usable_texts(low_rows_useless):
    df, rows = low_rows_useless
    texts, langs = language.training_rows(df, per_language=15)
    assert sorted(texts) == sorted(t for _, t, _, _ in rows[20:35]) and langs == ["xx"] * 15


def test_toxicity_rows_are_chosen_among_usable_texts(low_rows_useless):
    df, rows = low_rows_useless
    found = toxicity.training_texts(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxic_rows=8, ordinary_rows=12)
    for texts, toxic, n in zip(found, (1, 0), (8, 12), strict=True):
        assert sorted(texts) == sorted([t for _, t, _, y in rows[20:] if y == toxic][:n])
