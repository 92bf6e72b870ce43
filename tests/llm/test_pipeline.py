"""The pipeline against a brute-force version of its decisions."""

import random
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from bytesift.llm import language, simhash, toxicity, tokens  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    parts = {"aa": ["an", "er", "the", "ing", "st"], "bb": ["ez", "cion", "lo", "que", "ia"]}
    make = lambda v, n: " ".join("".join(rng.choice(parts[v]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs, labels, items = [], [], [(k, make("aa", 30)) for k in range(4)] + [(9, None)]
    for k in range(240):
        lang, toxic = ("aa", "bb")[k % 2], k % 8 == 3
        body = make(lang, rng.randint(20, 80))
        if toxic:
            body += f" grumblefig {make(lang, 9)} snortwort {make(lang, 5)}"
        docs.append((k, body, lang, "s", len(body)))
        labels.append((k, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 8 != 3]
    docs += [(1000 + k, clean[k % 5][1], "aa", "s", 1) for k in range(30)]  # copies
    docs += [(2000 + k, f"{make('aa', 9)} {items[k % 4][1]} {make('aa', 9)}", "aa", "s", 1) for k in range(6)]
    docs += [(3000, None, None, None, None), (3001, "", "aa", "s", 0), (3002, "12 !! 34", "aa", "s", 8), (None, make("aa", 40), "aa", "s", 1), (clean[7][0], clean[7][1], "aa", "s", 1)]
    out = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs, items


def test_stages_keep_what_they_should(spark, folder):
    out, docs, items = folder
    frame = spark.read.parquet(f"{out}/documents.parquet")
    rows = [tuple(r) for r in frame.collect()]
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(*toxicity.training_texts(frame, spark.read.parquet(f"{out}/labels.parquet")))
    gains = toxicity.Gains(model)

    def score(t):
        said = toxicity.words_of(t or "")
        return 1 / (1 + np.exp(-(model.weights[0] + np.dot(model.weights[1:], toxicity.features(gains(said), len(said))))))

    kept = stages["toxicity"](spark, frame, out)
    assert kept.columns == frame.columns
    want = [r for r in rows if score(r[1]) < toxicity.CUT]
    assert Counter(map(tuple, kept.collect())) == Counter(want)
    assert not any("grumblefig" in (r[1] or "") for r in want) and len(want) > 230

    frame = spark.createDataFrame(want, frame.schema).repartition(2)
    kept = [tuple(r) for r in stages["language"](spark, frame, out).collect()]
    lost = [r for r in want if r not in kept]
    assert {r[0] for r in lost} >= {3000, 3001, 3002} and len(lost) <= 5 and all(language.has_letter(r[1] or "") for r in kept)

    frame = spark.createDataFrame(kept, frame.schema).repartition(2)
    left = [tuple(r) for r in stages["simhash"](spark, frame, out).collect()]
    fps = [simhash.fingerprint(r[1]) for r in kept]
    up = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    first = {g: min((r[0] is None, r[0] or 0) for r, u in zip(kept, up, strict=True) if u == g) for g in set(up)}
    assert Counter((r[0] is None, r[0] or 0) for r in left) == Counter(first.values())

    frame = spark.createDataFrame(left, frame.schema).repartition(2)
    clean = [tuple(r) for r in stages["decontamination"](spark, frame, out).collect()]
    bodies = [t for _, t in items if t]
    assert Counter(clean) == Counter(r for r in left if not any(b in r[1] for b in bodies))

    packed = stages["packing"](spark, spark.createDataFrame(clean, frame.schema), out).collect()
    lengths = [len(x) // 4 + 1 for x in tokens.word_ids(tokens.word_path(), [r[1] for r in clean])]
    assert sum(r["length"] for r in packed) == sum(lengths)
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(lengths) // 2048) + 1


def test_run_applies_all_stages(spark, folder):
    out, docs, _ = folder
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, out).collect()}
    assert ids and not ids & {3000, 3001, 3002, *range(2000, 2006), *range(1000, 1030)}
    assert not ids & {k for k in range(240) if k % 8 == 3}
