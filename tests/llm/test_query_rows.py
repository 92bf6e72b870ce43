"""Every registered query over a small folder: columns, types, folds, one row where one is due; empty tables; clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

from bytesift.llm import decontamination, language, packing, queries, simhash, token_counts, toxicity

KINDS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_license_join": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_simhash_bktree": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_language_gru": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_decontamination": "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint",
    "op6_embedding_passes": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_toxicity_compression": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_katz_backoff": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.fixture(scope="module")
def folders(spark, odd_docs, no_docs, words, tmp_path_factory):
    out = {}
    for name, docs in (("full", odd_docs), ("empty", no_docs)):
        at = str(tmp_path_factory.mktemp(name))
        docs.withColumns({"row": F.lit(7), "leaks": F.lit("x"), "score": F.lit(0.5)}).write.parquet(f"{at}/documents.parquet")
        n = 0 if name == "empty" else 1000
        spark.range(12, 40).limit(n).selectExpr("id doc_id", "1 quality", "cast(id % 4 = 0 as int) toxic").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, " ".join(words[:20])), (2, None)], "item_id long, text string").limit(n).write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([(k, [1.0, k / 100, 0.0]) for k in range(9)] + [(9, None)], "vec_id long, embedding array<float>").limit(n).write.parquet(f"{at}/embeddings.parquet")
        out[name] = at
    return out


@pytest.mark.parametrize("name", sorted(KINDS))
def test_columns_rows_and_folds(spark, folders, name):
    df = queries.QUERIES[name](spark, folders["full"])
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == KINDS[name]
    rows, docs = df.collect(), spark.read.parquet(f"{folders['full']}/documents.parquet").select("doc_id").collect()
    if name.split("_")[0] not in ("op1", "op5", "op6"):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs)
    mod, held = (7, 2) if name.startswith("op10") else (3, 1)
    for r in rows:
        if "held_out" in df.columns:
            assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % mod == held)
    empty = queries.QUERIES[name](spark, folders["empty"])
    assert empty.dtypes == df.dtypes and empty.count() == 0


def test_no_column_is_lost(spark, odd_docs):
    names = ["row", "_row", "_counted", "_said", "_scored", "made", "leaks", "fp", "number", "first", "t", "Score"]
    docs = odd_docs.withColumns({c: F.lit(f"my {c}") for c in names})
    model, net = toxicity.fit([], []), language.train([], [])
    for out in (token_counts.count_tokens(docs), toxicity.score_toxicity(docs, model), language.predict(docs, net)):
        first = out.first().asDict()
        assert all(first[c] == f"my {c}" for c in names if c != "Score" or "score" not in out.columns) and out.count() == docs.count()
    assert decontamination.find_leaks(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).first()["row"] == "my row"
    assert simhash.near_duplicates(docs).count() == packing.pack_documents(docs).select("doc_id", "piece").where("piece = 0").count() == docs.count()


def test_pipeline_stages_keep_clashing_columns(spark, folders, odd_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["row", "_row", "number", "first", "made", "fp", "leaks"]
    docs = odd_docs.withColumns({c: F.lit(f"my {c}") for c in names})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders["full"])
        assert out.columns == docs.columns
        assert all(r[c] == f"my {c}" for r in out.collect() for c in names)


def test_pipeline_over_empty_tables(spark, folders):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, folders["empty"]).count() == 0
