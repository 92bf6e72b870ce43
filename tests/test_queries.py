"""Every query with SQL beside it, over the small tables."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from bytesift.functions.rules import LANGUAGES, LEAST, STRONG, WEAK
from bytesift.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as from '{SF}/{name}'")
    return con


def same(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df, sql = QUERIES[name](spark, SF), tables.sql(ORACLES[name])
    columns = sorted(sql.columns)
    assert sorted(df.columns) == columns
    got = Counter(tuple(same(r[c]) for c in columns) for r in df.collect())
    at = {c: k for k, c in enumerate(sql.columns)}
    assert got == Counter(tuple(same(r[at[c]]) for c in columns) for r in sql.fetchall())


def slow_language(run):
    best, found = 0, None
    for name, _, strong, weak in LANGUAGES:
        hard = sum(bool(re.search(p, run)) for p in strong)
        points = hard * STRONG + sum(bool(re.search(p, run)) for p in weak) * WEAK if hard else 0
        if points > best:
            best, found = points, name
    return found if best >= LEAST else "other" if len(run) >= 600 else None


def test_every_run_is_classified_and_kept(spark, tmp_path):
    code = "import os\nfrom a.b import c\nclass A(object):\n    def f(self):\n        return self.x\n" * 3
    prose = "nothing of any kind " * 40
    texts = [None, "", prose, code, prose[:200], prose[:200] + "\u00e9" + prose, code + "\u00e9" + prose[:300] + "\x00" + code * 4, prose[:100] + "\u00e9" + code, prose + "\u00e9" + prose]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["run_no"]): (r["length"], r["language"]) for r in QUERIES["kept_unknown"](spark, str(tmp_path)).collect()}
    want = {}
    for k, t in enumerate(texts):
        for n, run in enumerate(re.findall(r"[\t\n\r\x20-\x7e]{160,}", (t or "").encode().decode("latin1"))):
            if (language := slow_language(run)) is not None:
                want[k, n] = (len(run), language)
    assert got == want
    assert want[5, 1][1] == "other" and want[6, 2][1] == "python" and want[7, 0][1] == "python" and len([k for k in want if k[0] == 8]) == 2


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_crc_tags_equal_zlib(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["crc"] for r in QUERIES["crc_tags"](spark, SF).collect()}
    assert got == {k: zlib.crc32((t or "").encode()) for k, t in texts.items()}


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; from bytesift.queries import QUERIES, ORACLES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, timeout=120).returncode == 0
    left = copy / "corpus_pipeline.py"
    left.write_text("import bytesift.llm\n")  # only one of the two was deleted
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, timeout=120).returncode == 0
