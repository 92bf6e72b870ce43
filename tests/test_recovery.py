import hashlib
import os

import build_image as B
import pytest

from bytesift.functions.blocks import block_class
from bytesift.plans import recovery as R
from bytesift.sources import image

MIB = 1 << 20


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    out = {}
    for name, data in (("standard", B.standard()), ("varied", B.varied())):
        path = folder / f"{name}.img"
        path.write_bytes(data)
        out[name] = str(path)
    return out


def scan(spark, path, window=MIB, lookahead=65536):
    return R.Scan(spark, [path], {}, window, lookahead)


def test_analysis_of_the_standard_image(spark, images):
    figures, extents = R.analyze(scan(spark, images["standard"]), 65536)
    f = figures.collect()[0]
    assert (f["blocks_total"], f["blocks_zero"], f["blocks_ff"], f["blocks_text_like"], f["blocks_high_entropy"], f["blocks_other"]) == (128, 121, 0, 7, 0, 0)
    assert f["interesting_extents"] == 6 and round(f["dead_percent"], 2) == 94.53 and f["verdict"] == "mostly wiped"
    got = sorted((r["start"] // 65536, r["end"] // 65536) for r in extents.collect())
    assert got == [(0, 1), (32, 33), (48, 50), (64, 65), (80, 81), (96, 97)]


def test_block_classes():
    assert block_class(b"\xff" * 100, 100) == "ff" and block_class(b"\xff" * 100, 200) == "text"
    assert block_class(bytes(100) + b"x" * 16, 200) == "zero" and block_class(os.urandom(8192), 8192) == "high"


def test_records_and_paths(spark, images, tmp_path):
    found = R.recover_files(R.mft(scan(spark, images["standard"])), str(tmp_path))
    rows = sorted(found.collect(), key=lambda r: r["path"])
    assert [(r["path"], r["storage"], r["in_use"], r["modified"], r["recovered"]) for r in rows] == [("Vault.sol", "resident", True, "", "yes"), ("answer.rs", "resident", True, "", "yes")]
    assert (tmp_path / "answer.rs").read_bytes() == b"fn main() { println!(\"42\"); }"


@pytest.mark.parametrize("window", [MIB, 16384 + 512, 5000])
def test_records_do_not_depend_on_windows(spark, images, tmp_path, window):
    found = R.recover_files(R.mft(scan(spark, images["varied"], window, 2048)), str(tmp_path)).collect()
    got = sorted((r["path"], r["storage"], r["recovered"], r["recovered_path"]) for r in found)
    assert got == [
        ("a.txt", "resident", "yes", "a.txt"),
        ("a.txt", "resident", "yes", "a__1.txt"),
        ("big.bin", "non-resident", "yes", "big.bin"),
        ("empty", "resident", "yes", "empty"),
        ("gone.bin", "non-resident", "no", ""),
        ("long.txt", "resident", "yes", "long.txt"),
    ]
    assert (tmp_path / "big.bin").read_bytes() == b"R" * 4096 + bytes(4096) + b"R" * 1808


@pytest.mark.parametrize("window", [MIB, 3001])
def test_journal(spark, images, window):
    s = R.journal(scan(spark, images["standard"], window, 2048)).collect()
    assert [tuple(r)[2:] for r in s] == [("2022-06-18T04:26:40Z", "FILE_DELETE|CLOSE", 100, 5, "0x0", "answer.rs")]
    v = R.journal(scan(spark, images["varied"], window, 2048)).collect()
    assert [(r["reason"], r["name"]) for r in v] == [("FILE_CREATE", "late.txt"), ("0x00000400", "é中.txt")]


def test_archives(spark, images, tmp_path):
    whole, salvaged = R.zip_archives(scan(spark, images["standard"]))
    assert whole.count() == 1 and salvaged.count() == 0

    def unpacked(whole, salvaged, folder):
        rows = R.write_members(R.zip_members(whole, salvaged), str(folder)).collect()
        assert all(hashlib.sha256((folder / r["path"]).read_bytes()).hexdigest() == r["sha256"] for r in rows)
        return {r["name"]: ((folder / r["path"]).read_bytes(), r["status"]) for r in rows}

    assert unpacked(whole, salvaged, tmp_path / "a") == {"backup/utils.py": (B.SOURCE, "ok"), "backup/Main.kt": (b"fun main() { val x: Int = 1 }", "ok")}
    whole, salvaged = R.zip_archives(scan(spark, images["varied"]))
    inside = unpacked(whole, salvaged, tmp_path / "b")
    assert {"deep.txt", "one.txt", "two.txt", "other.txt"} <= set(inside) and all(s == "ok" for _, s in inside.values())
    assert inside["one.txt"][0] == b"one " * 100 and inside["deep.txt"][0] == b"deep " * 30
    assert [r["start"] for r in R.seven_zips(scan(spark, images["varied"])).collect()] == [MIB + 9 * 4096]
    z = R.gzips(scan(spark, images["varied"]))
    assert [(r["start"], r["method"]) for r in z.collect()] == [(2 * MIB + 131072, "whole")]
    R.copied(z, str(tmp_path), R.F.lit("packed")).collect()
    assert (tmp_path / "packed").read_bytes() == b"packed text " * 500
    written = R.copied(whole, str(tmp_path), R.F.lit("w.zip")).collect()
    assert written[0]["sha256"] == hashlib.sha256((tmp_path / "w.zip").read_bytes()).hexdigest()


def test_broken_members(spark, tmp_path):
    b = bytearray(MIB)
    wrong = bytearray(B.zip_bytes([("wrong.txt", b"checked " * 50)]))
    wrong = wrong[: wrong.index(b"PK\x01\x02")]
    wrong[14:18] = b"abcd"  # another CRC
    half = bytearray(B.zip_bytes([("half.txt", bytes(range(256)) * 40)]))
    half = half[: half.index(b"PK\x01\x02")]
    half[-20:] = b"\xff" * 20
    broken = bytearray(B.zip_bytes([("good.txt", b"good"), ("bad.txt", b"bad " * 90)], B.zipfile.ZIP_STORED))
    broken[broken.index(b"bad bad")] = 0
    for at, data in ((4096, wrong), (65536, half), (131072, broken)):
        B.place(b, at, bytes(data))
    (tmp_path / "i.img").write_bytes(bytes(b))
    rows = {r["name"]: r for r in R.write_members(R.zip_members(*R.zip_archives(scan(spark, str(tmp_path / "i.img")))), str(tmp_path / "out")).collect()}
    assert set(rows) == {"wrong.txt", "half.txt", "good.txt"}  # an unreadable member of a whole archive is passed over
    assert (rows["wrong.txt"]["status"], rows["half.txt"]["status"], rows["good.txt"]["status"]) == ("crcfail", "crcfail", "ok")
    assert (tmp_path / "out" / rows["wrong.txt"]["path"]).read_bytes() == b"checked " * 50


def test_images_keep_their_own_geometry(spark, tmp_path):
    small, large = bytearray(2 * MIB), bytearray(2 * MIB)
    B.place(small, 0, B.boot_sector())
    B.place(large, 0, B.boot_sector(code=0xF4))  # records of 4096
    for k, name in enumerate(["top", "x.txt"]):
        for img, step in ((small, 1024), (large, 4096)):
            B.place(img, 16384 + step * k, B.record(name, parent=0 if k else 5, content=None if k == 0 else b"in " + str(step).encode(), directory=k == 0))
    paths = []
    for name, data in (("s", small), ("l", large)):
        (tmp_path / f"{name}.img").write_bytes(bytes(data))
        paths.append(str(tmp_path / f"{name}.img"))
    found = R.mft(R.Scan(spark, paths, {}, MIB, 65536))
    got = {(r["image"], r["path"], r["off"]) for r in found.collect()}
    assert got == {(paths[0], "x.txt", 17408), (paths[1], "x.txt", 20480)}
    listed = R.recover_files(found, str(tmp_path / "out")).collect()
    assert sorted((r["recovered"], r["recovered_path"]) for r in listed) == [("yes", "x.txt"), ("yes", "x__1.txt")]
    assert {(tmp_path / "out" / p).read_bytes() for p in ("x.txt", "x__1.txt")} == {b"in 1024", b"in 4096"}


def test_colliding_files_are_all_on_disk(spark, tmp_path):
    rows = [("i", k, p, [0, 0], c.encode()) for k, (p, c) in enumerate([("d/a.txt", "one"), ("d/a.txt", "two"), ("d/a__1.txt", "three"), ("d/a.txt", "four")])]
    df = spark.createDataFrame([(i, k, p, c) for i, k, p, _, c in rows], "image string, off long, path string, resident_data binary")
    found = df.selectExpr("image", "off", "path", "cast(length(resident_data) as decimal(20,0)) size_bytes", "false is_dir", "true in_use", "'resident' storage", "'' modified", "resident_data", "cast(null as array<struct<start:bigint,length:bigint>>) spans")
    listed = R.recover_files(found, str(tmp_path)).collect()
    assert len(listed) == 4 and {(tmp_path / r["recovered_path"]).read_bytes() for r in listed} == {b"one", b"two", b"three", b"four"}


def test_reading_ends_where_the_disk_fails(tmp_path, monkeypatch):
    (tmp_path / "i.img").write_bytes(bytes(range(200)))
    held = image.Image(str(tmp_path / "i.img"))
    monkeypatch.setattr(image, "PART", 64)

    class Failing:
        def __init__(self, inner):
            self.inner, self.at = inner, 0

        def seek(self, at):
            self.at = at
            self.inner.seek(at)

        def read(self, n):
            if self.at >= 128:
                raise OSError("bad sector")
            return self.inner.read(n)

    held.file = Failing(held.file)
    assert held.read(0, 200) == bytes(range(128)) and held.read(128, 10) == b"" and held.read(-1, 5) == b""


@pytest.mark.parametrize("window", [MIB, 4099])
def test_media(spark, images, window):
    rows = R.manifest_of(R.media(scan(spark, images["standard"], window))).collect()
    assert sorted((r["ext"], r["size_bytes"]) for r in rows) == [("jpg", 77), ("mp4", 64), ("png", len(B.png()))]
    found = sorted((r["ext"], r["end"] - r["start"]) for r in R.media(scan(spark, images["varied"], window)).collect())
    want = [("gif", len(B.gif())), ("bmp", len(B.bmp())), ("webp", len(B.riff())), ("avi", len(B.riff())), ("mov", 64), ("heic", 64), ("wmv", 60), ("webm", len(B.mkv())), ("mkv", len(B.mkv()))]
    assert found == sorted(want)


@pytest.mark.parametrize("window", [MIB, 777])
def test_source_does_not_depend_on_windows(spark, images, window):
    rows = R.source(scan(spark, images["varied"], window), keep_unknown=False).collect()
    assert [(r["language"], r["length"], r["start"]) for r in rows] == [("python", len(B.SOURCE), 3 * MIB - 200)]


def test_extents_prune_and_dilate():
    assert image.own_ranges(100, [], 5) == [(0, 100)]
    assert image.own_ranges(100, [(10, 20), (24, 30), (90, 99)], 5) == [(10, 35), (90, 100)]


def test_everything(spark, images, tmp_path):
    out = str(tmp_path / "out")
    results = R.recover_all(spark, [images["standard"]], out, 65536, MIB, 65536)
    assert results["mft"] == {"listed": 2, "resident": 2, "targeted": 0, "wiped": 0} and results["usn"] == {"events": 1, "deletes": 1}
    assert results["cards"] == {"recovered": 2, "deletions": 1, "media": 3, "source": sum(results["source"].values())}
    lines = [r["value"] for r in spark.read.text(f"{out}/00_analysis/report").collect()]
    assert lines[0] == "REGION ANALYSIS" and any(x.startswith("zeroed blocks     : 121 (94.5%)") for x in lines)
    listed = [(r["path"], r["level"], r["is_dir"]) for r in image.tree(spark, f"{out}/40_media/photos").collect()]
    assert len(listed) == 2 and all(level == 0 and not is_dir for _, level, is_dir in listed)
    below = image.tree(spark, f"{out}/40_media").collect()
    assert [r["path"] for r in below] == sorted((r["path"] for r in below), key=lambda p: p.split("/")) and {("photos", True), ("videos", True)} <= {(r["path"], r["is_dir"]) for r in below}
    assert {r["path"] for r in image.tree(spark, f"{out}/40_media", depth=0).where("is_dir").collect()} == {"media_manifest", "photos", "videos"}
    assert results["zip"] == {"whole": 1, "salvaged": 0, "members": 2} and results["media"] == {"jpg": 1, "png": 1, "mp4": 1}
    assert results["source"].get("python") == 1
    assert image.manifest(spark, f"{out}/10_mft/usn_journal").collect()[0]["name"] == "answer.rs"
    assert any(r["value"].startswith("[media]") for r in spark.read.text(f"{out}/summary").collect())
    regions = image.regions(spark, f"{out}/00_analysis/regions")
    assert [len(v) for v in regions.values()] == [6]
    assert image.files(spark, f"{out}/40_media/photos").count() == 2
    assert image.regions(spark, f"{out}/missing") == {}


