import random
import struct
import zlib

import build_image as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from bytesift.functions import blocks, carvers, columns, records
from bytesift.operators import aggregates, intervals, names, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("ticks,want", [(B.TICKS, "2022-06-18T04:26:40Z"), (116_444_736_000_000_000, "1970-01-01T00:00:00Z"), (0, ""), (1, ""), (2**62, "")])
def test_filetime(spark, ticks, want):
    assert one(spark, columns.filetime_iso, ticks, "long") == want == records.filetime_text(ticks)


@pytest.mark.parametrize("reason,want", [(0x80000200, "FILE_DELETE|CLOSE"), (0x400, "0x00000400"), (0x600, "FILE_DELETE")])
def test_reasons(spark, reason, want):
    assert one(spark, columns.reason_names, reason, "long") == want


@pytest.mark.parametrize("path,want", [("C:\\a\\..\\b", "a/b"), (".gitignore", "gitignore"), ("a<b>.txt", "a_b_.txt"), ("", "unnamed"), ("...", "unnamed"), (" a /x" + "y" * 300, "a/x" + "y" * 199), ("a\t/\u00a0b\u3000", "a/b"), (None, "unnamed")])
def test_paths(spark, path, want):
    assert one(spark, columns.sanitized_path, path) == want


def test_scalars(spark):
    assert one(spark, columns.human_size, 1536, "long") == "1.5 KiB"
    assert one(spark, lambda c: F.crc32(c), b"hello", "binary") == zlib.crc32(b"hello")
    assert one(spark, columns.human_size, -5000, "long") == "-4.9 KiB" and one(spark, columns.human_size, -3, "long") == "-3.0 B"
    for data, bits in ((b"", 0), (b"aabb", 1), (bytes(range(256)), 8)):
        assert blocks.entropy_bits(data) == pytest.approx(bits)
    assert one(spark, lambda c: columns.byte_count(c, 0), b"\x00a\x00\xff", "binary") == 2 and one(spark, lambda c: columns.byte_count(c, 255), b"\xff.", "binary") == 1
    df = spark.createDataFrame([(1, b"aabb"), (2, b""), (3, bytes(range(256)))], "k long, d binary")
    got = {r["k"]: r["entropy"] for r in aggregates.byte_entropy(df, "k", "d").collect()}
    assert got == {1: pytest.approx(1), 2: 0, 3: pytest.approx(8)}
    assert one(spark, columns.latin1, bytes(range(256)), "binary") == bytes(range(256)).decode("latin-1")


def test_data_runs():
    assert records.data_runs(bytes.fromhex("21183456110 5FE0110 00".replace(" ", ""))) == [(24, 22068), (5, 22066), (16, None)]
    rng = random.Random(0)
    for _ in range(200):
        runs, raw, last = [], b"", 0
        for _ in range(rng.randint(1, 6)):
            n, lcn = rng.randint(1, 1 << 20), rng.randint(0, 1 << 30)
            runs.append((n, lcn))
            raw += bytes([0x43]) + n.to_bytes(3, "little") + (lcn - last).to_bytes(4, "little", signed=True) if abs(lcn - last) < 2**31 else b""
            last = lcn
        assert records.data_runs(raw + b"\x00") == runs


def test_vint():
    assert records.vint(b"\x81", False) == (1, 1, False) and records.vint(b"\x40\x02", False) == (2, 2, False)
    assert records.vint(b"\xff", False)[2] and records.vint(b"\x00", False)[0] is None
    assert records.vint(b"\x1a\x45\xdf\xa3", True)[0] == 0x1A45DFA3


def test_geometry_of_partitions():
    data = bytearray(1 << 20)
    data[510:512] = b"\x55\xaa"
    data[446 + 4], data[446 + 8 : 446 + 12] = 0x07, struct.pack("<I", 64)
    data[64 * 512 : 64 * 512 + 512] = B.boot_sector()
    data[512:520], data[584:592], data[592:600] = b"EFI PART", struct.pack("<Q", 2), struct.pack("<II", 4, 128)
    for k, lba in enumerate((64, 256)):
        data[1024 + 128 * k : 1024 + 128 * k + 16] = b"x" * 16
        data[1024 + 128 * k + 32 : 1024 + 128 * k + 40] = struct.pack("<Q", lba)
    data[256 * 512 : 257 * 512] = B.boot_sector(code=2)
    found = records.partitions(lambda at, n: bytes(data[at : at + n]))
    assert [(g["part_offset"], g["mft_record_size"]) for g in found] == [(64 * 512, 1024), (256 * 512, 8192)]


def test_truncated_inputs_decode_to_nothing():
    full = {"gif": B.gif(), "bmp": B.bmp(), "riff": B.riff(), "asf": B.asf(), "7z": B.seven()}
    for name, data in full.items():
        for n in range(0, 12):
            cut = data[:n]
            read = lambda at, k, cut=cut: cut[at : at + k] if at >= 0 else b""
            for f in (carvers.gif, carvers.bmp, carvers.riff, carvers.iso_media, carvers.asf, carvers.seven_zip, carvers.gzip_stream, carvers.zip_whole, carvers.zip_member):
                assert f(read, len(cut), 0) is None, (name, n, f)
    rng = np.random.default_rng(0)
    for _ in range(300):
        noise = b"FILE" + rng.bytes(1020)
        records.file_record(noise)
        records.journal_record(rng.bytes(80))


def slow_islands(rows, gap, touching):
    out, reach, k = [], None, 0
    for s, e in sorted(rows):
        if reach is None or (s - reach > gap if touching else s - reach >= gap):
            k += 1
        reach = e if reach is None else max(reach, e)
        out.append((s, e, k))
    return out


@pytest.mark.parametrize("zone,touching,gap", [(10, True, 0), (10, False, 0), (64, True, 3), (1 << 30, True, 3)])
def test_islands(spark, zone, touching, gap):
    rng = random.Random(zone)
    rows = [(s, s + rng.randint(1, 30)) for s in (rng.randrange(2000) for _ in range(150))]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, s long, e long")
    got = sorted((r["s"], r["e"], r["island"]) for r in intervals.islands(df, ["g"], "s", "e", gap, zone, touching).collect())
    assert got == slow_islands(rows, gap, touching)


def test_gap_merge_example(spark):
    df = spark.createDataFrame([("x", b, b + 1) for b in (0, 1, 9, 19, 30)], "g string, s long, e long")
    assert sorted((r["s"], r["e"]) for r in intervals.merge_gaps(df, ["g"], "s", "e", 8).collect()) == [(0, 10), (19, 20), (30, 31)]


def test_greedy_and_outside(spark):
    rng = random.Random(9)
    rows = [(k, s, s + rng.randint(1, 60)) for k, s in enumerate(rng.randrange(3000) for _ in range(200))]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, k long, s long, e long")
    taken = []
    for k, s, e in rows:
        if all(e <= a or b <= s for _, a, b in taken):
            taken.append((k, s, e))
    got = intervals.greedy(df, ["g"], "s", "e", ["k"], zone=500)
    assert sorted((r["k"], r["s"], r["e"]) for r in got.collect()) == taken
    left, right = df.where("k % 2 = 0"), df.where("k % 9 = 1")
    holes = [(s, e) for k, s, e in rows if k % 9 == 1]
    want = [k for k, s, e in rows if k % 2 == 0 and all(e <= a or b <= s for a, b in holes)]
    assert sorted(r["k"] for r in intervals.outside(left.unionByName(left), right, ["g"], "s", "e", zone=16).collect()) == sorted(want * 2)
    points = df.select("g", "k", "s")
    inside = [k for k, s, _ in rows if any(a <= s < b for a, b in holes)]
    for zone in (16, 1 << 30):
        assert sorted(r["k"] for r in intervals.within(points, right, ["g"], "s", "s", "e", zone).collect()) == inside
    assert intervals.within(points, right.limit(0), ["g"], "s", "s", "e").count() == 200


def test_paths_of_records(spark):
    rows = [(10, "a", 5), (11, "b", 10), (12, "c", 11), (13, "lost", 99), (14, "self", 14), (15, "x", 16), (16, "y", 15)]
    rows += [(100 + k, f"d{k}", 99 + k if k else 5) for k in range(80)]
    got = {r["entry"]: r["path"] for r in names.resolve_paths(spark.createDataFrame(rows, "entry long, name string, parent long")).collect()}
    assert (got[12], got[13], got[14]) == ("a/b/c", "lost", "self")
    assert got[15].endswith("y/x") and got[179].count("/") == 63 and got[179].endswith("d78/d79") and got[150].startswith("d0/d1/")


def test_the_last_record_of_an_entry_is_the_ancestor(spark):
    rows = [(10, "old", 5, 1), (10, "new", 5, 2), (11, "child", 10, 3), (12, "one", 11, 4), (12, "two", 10, 5), (13, "leaf", 12, 6)]
    df = spark.createDataFrame(rows, "entry long, name string, parent long, off long")
    got = {r["off"]: r["path"] for r in names.resolve_paths(df, order="off").collect()}
    assert got == {1: "old", 2: "new", 3: "new/child", 4: "new/child/one", 5: "new/two", 6: "new/two/leaf"}


@pytest.mark.parametrize("zone", [1, 3, 1000])
def test_unique_names_never_clash(spark, zone):
    paths = ["d/a.txt", "d/a.txt", "d/a__1.txt", "d/a.txt", "d/a__3.txt", "d/a__1.txt", None, "unnamed", "x", "x", "d/a__03.txt", "d/a.txt"]
    rng = random.Random(zone)
    paths += [f"z{'__' * (n > 0)}{n or ''}.b" for n in (rng.randrange(4) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(paths)), "k long, p string").repartition(3)
    got = {r["k"]: r["u"] for r in names.unique_names(df, "p", ["k"], "u", F.floor(F.col("k") / zone)).collect()}
    assert len(set(got.values())) == len(paths)
    firsts = {p or "unnamed": k for k, p in reversed(list(enumerate(paths)))}
    assert all(got[k] == p for p, k in firsts.items())
    assert [got[k] for k in range(12)] == ["d/a.txt", "d/a__2.txt", "d/a__1.txt", "d/a__4.txt", "d/a__3.txt", "d/a__1__1.txt", "unnamed", "unnamed__1", "x", "x__1", "d/a__03.txt", "d/a__5.txt"]


def test_sizes_of_records():
    def sizes(**how):
        r = records.file_record(B.record("n", **how))
        return r["real_size"], r["resident"], r["runs"]

    assert sizes(content=b"hello", size=3) == (5, b"hello", []) and sizes(content=b"hello", size=9) == (9, b"hello", [])
    assert sizes(runs=bytes([0x11, 1, 4]), size=0)[0] == 0
    both = records.file_record(B.record("n", content=b"kept", runs=bytes([0x11, 1, 4]), size=700))
    assert both["resident"] == b"kept" and both["runs"] == [(1, 4)] and both["real_size"] == 700
    cut = bytearray(B.record("n", content=b"beyond"))
    end = 0x38 + records.le(cut[0x3C:0x40])
    cut[0x18:0x1C] = struct.pack("<I", end + records.le(cut[end + 4 : end + 8]))  # what follows the name isn't in use
    assert records.file_record(bytes(cut))["resident"] is None


def test_a_bomb_is_never_held(monkeypatch):
    bomb = zlib.compressobj(9, zlib.DEFLATED, 31)
    data = b"".join(bomb.compress(bytes(1 << 20)) for _ in range(64)) + bomb.flush()
    parts = [len(p) for p in carvers.Inflater(31).feed(data)]
    assert sum(parts) == 64 << 20 and max(parts) <= carvers.STEP
    found = carvers.gzip_stream(lambda at, n: data[at : at + n], len(data), 0)
    assert (found.length, found.method) == (len(data), "whole")


def test_the_text_that_a_pattern_needs():
    assert [text.needed(p) for p in (r"\bfn\s+main\s*\(", "a|b", "(?:x)?", r"#\[derive\(", "ab+c")] == ["main", "", "", "#[derive(", "a"]


def test_patterns_are_in_the_plan_once(spark):
    from bytesift.functions.rules import LANGUAGES

    df = spark.range(1).select(F.col("id").cast("string").alias("t")).select(text.classified(F.col("t")).alias("c")).select("c.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= sum(len(s) + len(w) for _, _, s, w in LANGUAGES)


def test_picked_names(spark):
    kind = "array<struct<ns:int,name:string,parent:bigint>>"
    pick = lambda v: one(spark, lambda c: names.picked_name(c)["name"], v, kind)
    assert pick([(2, "LONGNAME~1.TXT", 5), (1, "b.txt", 5)]) == "b.txt"
    assert pick([(1, "b", 5), (3, "longer", 5), (0, "longes", 5)]) == "longer"
    assert pick([(2, "DOS", 5)]) == "DOS" and pick([]) is None


def test_languages(spark):
    from bytesift.queries import _SNIPPETS

    df = spark.createDataFrame([(k, s) for k, s in enumerate(_SNIPPETS)], "k long, t string")
    got = {r["k"]: r["c"]["language"] for r in df.select("k", text.classified(F.col("t")).alias("c")).collect()}
    assert [got[k] for k in range(len(_SNIPPETS))] == ["rust", "kotlin", "python", "solidity", "javascript", "go", "c_cpp", "json", "toml_cfg", "markdown", None]
    assert one(spark, lambda c: text.classified(c)["score"], "def f(\r# title") == 0  # CR ends no line
