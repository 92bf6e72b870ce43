from pyspark.sql import functions as F

from bytesift.streaming import manifests


def test_cards_follow_the_files(spark, tmp_path):
    folder, seen = tmp_path / "m", {}
    folder.mkdir()
    rows = manifests.stream_manifest(spark, str(folder), "path string, recovered string")
    cards = manifests.running_cards(rows, {"files": F.lit(True), "recovered": F.rlike("recovered", F.lit("^(yes|partial)"))})
    query = manifests.start(cards, str(tmp_path / "c"), lambda df, _: seen.update({r["card"]: r["n"] for r in df.collect()}))
    try:
        for k, body in enumerate(("a,yes\nb,no\n", "c,partial (half)\n")):
            (folder / f"{k}.csv").write_text("path,recovered\n" + body)
            query.processAllAvailable()
    finally:
        query.stop()
    assert seen == {"files": 3, "recovered": 2}
