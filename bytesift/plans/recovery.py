"""Plans over raw images: analysis, file records, change journal, archives, media, source text.

Scans find places and hand on narrow descriptors (image, start, length); bytes are read again by
range only where a file is validated or written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.functions import carvers, records
from bytesift.functions import columns as C
from bytesift.functions.blocks import block_class
from bytesift.operators import aggregates, intervals, names, text
from bytesift.sources import image, sinks
from bytesift.storage import materialise

BLOCK, BRIDGE = 1 << 20, 8
RUN_LIMIT = 64 << 20
#: Bytes of content that a task hands on at once.
HELD = 32 << 20


@dataclass
class Scan:
    """Images to scan, the extents to keep to, and the sizes of windows."""

    spark: SparkSession
    paths: list[str]
    extents: dict[str, list] = field(default_factory=dict)
    window: int = image.WINDOW
    lookahead: int = image.LOOKAHEAD

    def chunks(self, everything: bool = False, lookahead: int | None = None) -> DataFrame:
        return image.scan(self.spark, self.paths, {} if everything else self.extents, self.window, self.lookahead if lookahead is None else lookahead)


# --- analysis --------------------------------------------------------------------------------------


def blocks(scan: Scan, block: int = BLOCK) -> DataFrame:
    """(image, start, end, class) of every block."""
    chunks = image.scan(scan.spark, scan.paths, {}, max(block, scan.window // block * block), 0)

    def classes(batches):
        for pdf in batches:
            rows = []
            for path, base, data in zip(pdf["image"], pdf["base"], pdf["data"], strict=True):
                rows += [(path, base + k, base + k + len(part), block_class(part, block)) for k in range(0, len(data), block) if (part := data[k : k + block])]
            yield pd.DataFrame(rows, columns=["image", "start", "end", "class"])

    return chunks.mapInPandas(classes, "image string, start long, end long, class string")


def analyze(scan: Scan, block: int = BLOCK, bridge: int = BRIDGE) -> tuple[DataFrame, DataFrame]:
    """(figures, extents): counts of classes by image, and live blocks united over gaps of at most ``bridge`` blocks."""
    found = blocks(scan, block)
    live = found.where(~F.col("class").isin("zero", "ff"))
    extents = intervals.merge_gaps(live.select("image", "start", "end"), ["image"], "start", "end", bridge * block)
    counts = [F.count_if(F.col("class") == c).alias(f"blocks_{n}") for c, n in (("zero", "zero"), ("ff", "ff"), ("text", "text_like"), ("high", "high_entropy"), ("other", "other"))]
    figures = found.groupBy("image").agg(F.max("end").alias("image_size"), F.lit(block).alias("block_size"), F.count("*").alias("blocks_total"), *counts)
    area = extents.groupBy("image").agg(F.sum("members").alias("interesting_blocks"), F.count("*").alias("interesting_extents"), F.sum(F.col("end") - F.col("start")).alias("interesting_bytes"))
    figures = figures.join(area, "image", "left").fillna(0, ["interesting_blocks", "interesting_extents", "interesting_bytes"])
    dead = aggregates.dead_percent(F.col("blocks_zero"), F.col("blocks_ff"), F.col("blocks_total"))
    verdict = F.when(dead > 99, "TRIM almost certainly completed").when(dead > 85, "mostly wiped").otherwise("much data survived")
    return figures.withColumn("dead_percent", dead).withColumn("verdict", verdict), extents


def report(figures: DataFrame) -> DataFrame:
    """(image, line, value): the analysis of each image as lines of text, with the share of each class and what to do next."""

    def share(label: str, column: str, meaning: str):
        percent = F.col(column) * 100.0 / F.greatest(F.col("blocks_total"), F.lit(1))
        return F.format_string(f"%-18s: %d (%.1f%%)   {meaning}", F.lit(label), F.col(column), percent)

    advice = (
        F.when(F.col("dead_percent") > 99, "Nearly all is dead: file records with resident content and the change journal are what is left to try.")
        .when(F.col("dead_percent") > 85, "Some data survived: file records and the journal first, then archives and source text in the live extents.")
        .otherwise("Much data survived: every phase is worth running.")
    )
    lines = F.array(
        F.lit("REGION ANALYSIS"),
        F.format_string("%-18s: %s", F.lit("image"), F.col("image")),
        F.concat(F.rpad(F.lit("size"), 18, " "), F.lit(": "), C.human_size(F.col("image_size"))),
        share("zeroed blocks", "blocks_zero", "wiped or never written"),
        share("0xFF blocks", "blocks_ff", "erased"),
        share("text-like blocks", "blocks_text_like", "may be source text"),
        share("high-entropy", "blocks_high_entropy", "may be archives or encrypted"),
        share("other", "blocks_other", ""),
        F.format_string("%-18s: %.1f%%", F.lit("dead"), F.col("dead_percent")),
        F.concat(F.rpad(F.lit("live area"), 18, " "), F.lit(": "), C.human_size(F.col("interesting_bytes")), F.format_string(" in %d extents", F.col("interesting_extents"))),
        F.concat(F.lit("verdict           : "), F.col("verdict")),
        advice,
    )
    return figures.select("image", F.posexplode(F.transform(lines, lambda x: F.rtrim(x))).alias("line", "value"))


# --- file records ----------------------------------------------------------------------------------

RECORDS = (
    "image string, off long, in_use boolean, is_dir boolean, seq int, names array<struct<ns:int,name:string,parent:bigint>>, real_size decimal(20,0), alloc_size decimal(20,0), "
    "resident_data binary, data_runs array<struct<len:bigint,lcn:bigint>>, created string, modified string"
)


def geometry(scan: Scan) -> DataFrame:
    """One row for each volume found: boot sector, MBR slots or GPT entries."""
    rows = [{"image": p, **g} for p in scan.paths for g in records.partitions(image.open_image(p).read)]
    kinds = "image string, part_offset bigint, bytes_per_sector int, sectors_per_cluster int, bytes_per_cluster int, mft_lcn bigint, mft_offset bigint, mft_record_size int, total_sectors bigint"
    return scan.spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)


def file_records(scan: Scan, record_size: int | dict[str, int] = 1024, cap: int | None = None) -> DataFrame:
    """Decoded records wherever they lie, the first ``cap`` by offset if one is given (a global sort). ``record_size`` may differ by image. The gate runs inside the scan, before a record is decoded."""
    sizes = record_size if isinstance(record_size, dict) else dict.fromkeys(scan.paths, record_size)

    def decode(batches):
        for pdf in batches:
            rows = []
            for path, base, own, data in zip(pdf["image"], pdf["base"], pdf["own_len"], pdf["data"], strict=True):
                size, at = sizes.get(path, 1024), data.find(b"FILE")
                while 0 <= at < own:
                    if r := records.file_record(data[at : at + size]):
                        runs = [{"len": n, "lcn": lcn} for n, lcn in r["runs"]]
                        named = [{"ns": a, "name": b, "parent": c} for a, b, c in r["names"]]
                        rows.append((path, base + at, r["in_use"], r["is_dir"], r["seq"], named, r["real_size"], r["alloc_size"], r["resident"], runs, records.filetime_text(r["created"]), records.filetime_text(r["modified"])))
                    at = data.find(b"FILE", at + 1)
            out = pd.DataFrame(rows, columns=["image", "off", "in_use", "is_dir", "seq", "names", "real_size", "alloc_size", "resident_data", "data_runs", "created", "modified"])
            for c in ("real_size", "alloc_size"):
                out[c] = [Decimal(v) for v in out[c]]
            yield out

    found = scan.chunks(everything=True, lookahead=max([scan.lookahead, *sizes.values()])).mapInPandas(decode, RECORDS)
    return found if cap is None else found.orderBy("image", "off").limit(cap)


CLUSTER, RECORD = 4096, 1024


def volumes(scan: Scan, record_size: int | None = None, first: int | None = None) -> DataFrame:
    """(image, number, part_offset, bytes_per_cluster, mft_offset, mft_record_size), one row for each image: of its first volume, else clusters of 4096, records of 1024 and no known first record."""
    found: dict[str, dict] = {}
    for r in geometry(scan).collect():  # a few rows an image
        if r["image"] not in found or r["part_offset"] < found[r["image"]]["part_offset"]:
            found[r["image"]] = r.asDict()
    rows = []
    for k, path in enumerate(scan.paths):
        g = found.get(path, {})
        start = first if first is not None else g.get("mft_offset")
        rows.append((path, k, g.get("part_offset", 0), g.get("bytes_per_cluster", CLUSTER), start, record_size or g.get("mft_record_size", RECORD)))
    return scan.spark.createDataFrame(rows, "image string, number long, part_offset long, bytes_per_cluster long, mft_offset long, mft_record_size long")


def mft(scan: Scan, record_size: int | None = None, first: int | None = None) -> DataFrame:
    """Manifest of files: path, size, where the content is, and its spans or resident bytes.

    Each image is read by the geometry of its own first volume; a given ``first`` or ``record_size`` stands before it.
    Directories and empty names are left out; without a known first record names stand for paths.
    """
    volume = volumes(scan, record_size, first)
    sizes = {r["image"]: r["mft_record_size"] for r in volume.collect()}
    rows = file_records(scan, sizes).join(volume, "image").withColumn("picked", names.picked_name(F.col("names")))
    rows = rows.select("*", F.col("picked.name").alias("name"), F.col("picked.parent").alias("parent"))
    at = F.col("off") - F.col("mft_offset")
    base = F.shiftleft(F.col("number"), 48)
    entry = F.when((at >= 0) & (F.pmod(at, F.col("mft_record_size")) == 0), base + F.floor(at / F.col("mft_record_size")).cast("long"))
    # records outside the table have a path too, but are nobody's parent
    own = F.coalesce(entry, -F.col("off") - 1)
    parent = F.when(F.col("mft_offset").isNull(), F.lit(0)).when(~F.col("parent").isin(0, names.ROOT), base + F.col("parent")).otherwise(F.col("parent"))
    rows = materialise(rows.withColumn("entry", own).withColumn("up", parent), "file-records")
    nodes = rows.select("image", "off", "entry", "name", F.col("up").alias("parent"))
    paths = names.resolve_paths(nodes.where("name <> ''"), order="off").select(F.col("image").alias("_image"), F.col("off").alias("_off"), F.col("path").alias("_path"))
    kept = rows.where(~F.col("is_dir") & (F.length("name") > 0)).join(paths, (F.col("image") == F.col("_image")) & (F.col("off") == F.col("_off")))
    resident = F.col("resident_data").isNotNull() & ((F.octet_length("resident_data") > 0) | (F.size("data_runs") == 0))
    spans = F.transform("data_runs", lambda r: F.struct((F.col("part_offset") + r["lcn"] * F.col("bytes_per_cluster")).alias("start"), (r["len"] * F.col("bytes_per_cluster")).alias("length")))
    content = F.when(F.col("real_size") > 0, F.substring(F.col("resident_data"), F.lit(1), F.least(F.col("real_size"), F.lit(1 << 30)).cast("int"))).otherwise(F.col("resident_data"))
    content = F.when(resident, content)
    return kept.select("image", "off", F.col("_path").alias("path"), F.col("real_size").alias("size_bytes"), "is_dir", "in_use", C.storage_label(resident, F.size("data_runs"), F.col("real_size")).alias("storage"), "modified", content.alias("resident_data"), F.when(~resident, spans).alias("spans"))


def cut_spans(spans, size):
    """Spans cut to the file's size."""
    zero = F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("kept"))
    step = lambda a, s: F.struct((a["before"] + s["length"]).alias("before"), F.when(a["before"] < size, F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), F.least(s["length"], size - a["before"]).alias("length"))))).otherwise(a["kept"]).alias("kept"))
    return F.aggregate(spans, zero, step)["kept"]


def recover_files(found: DataFrame, folder: str) -> DataFrame:
    """Write the files of ``mft`` and return the manifest with recovered, recovered_path and note."""
    zone = F.struct("image", F.floor(F.col("off") / intervals.ZONE).alias("z"))  # one bare name may be all files'
    rows = names.unique_names(found.withColumn("target", C.sanitized_path(F.col("path"))), "target", ["image", "off"], "recovered_path", zone)
    rows = materialise(rows, "named-files")
    size = F.col("size_bytes").cast("long")
    pieces = rows.where("storage IN ('resident', 'non-resident')").select("image", F.col("recovered_path").alias("path"), F.when(F.col("spans").isNotNull(), cut_spans(F.col("spans"), size)).alias("spans"), F.col("resident_data").alias("content"))
    written = sinks.write_files(pieces, folder).select(F.col("path").alias("recovered_path"), "bytes", "nonzero")
    out = rows.join(written, "recovered_path", "left")
    wiped = (F.col("storage") == "non-resident") & (F.col("nonzero") == 0)
    done = F.when(wiped, "no").when(F.col("bytes").isNull(), "no").when(F.col("bytes") < size, "partial").otherwise("yes")
    note = F.when(wiped, "clusters are zero (TRIMed)").when(F.col("storage") == "none", "no content found").otherwise("")
    return out.select("path", "size_bytes", "is_dir", "in_use", "storage", "modified", done.alias("recovered"), F.when(done != "no", F.col("recovered_path")).otherwise("").alias("recovered_path"), note.alias("note"))


# --- change journal ----------------------------------------------------------------------------------


def journal(scan: Scan, cap: int | None = None) -> DataFrame:
    """Events of the change journal, the first ``cap`` by offset if one is given."""

    def decode(batches):
        for pdf in batches:
            rows = []
            for path, base, own, data in zip(pdf["image"], pdf["base"], pdf["own_len"], pdf["data"], strict=True):
                at = data.find(b"\x02\x00\x00\x00")
                while at >= 0 and at - 4 < own:
                    if at >= 4 and (r := records.journal_record(data[at - 4 : at + 0x400])):
                        rows.append((path, base + at - 4, r["ticks"], r["reason"], r["file_ref"], r["parent_ref"], r["attrs"], r["name"]))
                    at = data.find(b"\x02\x00\x00\x00", at + 1)
            yield pd.DataFrame(rows, columns=["image", "off", "ticks", "reason", "file_ref", "parent_ref", "attrs", "name"]).astype({"ticks": "uint64"}).assign(ticks=lambda d: d["ticks"].clip(upper=2**63 - 1).astype("int64"))

    found = scan.chunks().mapInPandas(decode, "image string, off long, ticks long, reason long, file_ref long, parent_ref long, attrs long, name string")
    rows = found if cap is None else found.orderBy("image", "off").limit(cap)
    return rows.select("image", "off", C.filetime_iso(F.col("ticks")).alias("timestamp"), C.reason_names(F.col("reason")).alias("reason"), "file_ref", "parent_ref", C.hex_offset(F.col("attrs")).alias("attrs"), "name")


def _in_parts(rows, columns: list[str], content: str):
    """Frames of the rows (an iterator), each with about HELD bytes of content at most, or one row."""
    at, held, size = columns.index(content), [], 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"")
        if size >= HELD:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


# --- carving -----------------------------------------------------------------------------------------

PIECES = "image string, off long, sig_rank int, start long, end long, kind string, ext string, method string"


def _carve(found: DataFrame, carver, more: str = "") -> DataFrame:
    """Run ``carver(read, size, off, sig_rank)`` at every hit; it gives (Found, further values) or None. Only descriptors go on."""
    columns = [c.split()[0] for c in (PIECES + more).split(", ")]

    def carve(batches):
        for pdf in batches:
            rows = []
            for path, off, rank in zip(pdf["image"], pdf["off"], pdf["sig_rank"], strict=True):
                held = image.open_image(path)
                if got := carver(held.read, held.size, int(off), int(rank)):
                    f, *rest = got
                    rows.append((path, off, rank, f.start, f.start + f.length, f.kind, f.ext, f.method, *rest))
            yield pd.DataFrame(rows, columns=columns)

    return found.mapInPandas(carve, PIECES + more)


def _plain(handler):
    return lambda read, size, off, rank: (f,) if (f := handler(read, size, off)) else None


def zip_archives(scan: Scan) -> tuple[DataFrame, DataFrame]:
    """(whole archives, members salvaged outside them): by end record, then by local header. Nothing is unpacked yet."""
    whole = _carve(image.hits(scan.chunks(), [b"PK\x05\x06"]), _plain(carvers.zip_whole))
    whole = intervals.greedy(whole, ["image"], "start", "end", ["off"])
    salvaged = _carve(image.hits(scan.chunks(), [b"PK\x03\x04"]), lambda read, size, off, rank: carvers.zip_member(read, size, off), ", begin long, packed long, codec string, crc long")
    return whole, intervals.outside(salvaged, whole, ["image"], "start", "end")


MEMBERS = "image string, start long, name string, spans array<struct<start:bigint,length:bigint>>, codec string, entry long, crc long"


def zip_members(whole: DataFrame, salvaged: DataFrame) -> DataFrame:
    """(image, start, name, spans, codec, entry, crc) of every member: where its bytes lie and how the sink unpacks them.

    Of a whole archive only the directory is read. ``crc`` is the header's, for salvaged members only.
    """

    def listed(batches):
        for pdf in batches:
            rows = []
            for path, s, e in zip(pdf["image"], pdf["start"], pdf["end"], strict=True):
                try:
                    with sinks.open_archive(path, int(s), int(e - s)) as z:
                        span = [{"start": int(s), "length": int(e - s)}]
                        rows += [(path, s, info.filename, span, "zip", k, None) for k, info in enumerate(z.infolist()) if not info.is_dir()]
                except sinks.UNREADABLE:
                    continue  # an archive whose directory can't be read has no members
            yield pd.DataFrame(rows, columns=["image", "start", "name", "spans", "codec", "entry", "crc"]).astype({"entry": "Int64", "crc": "Int64"})

    inside = whole.select("image", "start", "end").mapInPandas(listed, MEMBERS)
    spans = F.array(F.struct(F.col("begin").alias("start"), F.col("packed").alias("length")))
    return inside.unionByName(salvaged.select("image", "start", F.col("method").alias("name"), spans.alias("spans"), "codec", F.lit(None).cast("long").alias("entry"), "crc"))


def write_members(members: DataFrame, folder: str) -> DataFrame:
    """Unpack and write members, each once, and return their manifest: image, start, name, path, bytes, sha256 and status.

    status: ``ok``, or ``crcfail`` where a salvaged member's bytes differ from its header's CRC (if that isn't 0).
    """
    place = F.lpad(F.lower(F.hex("start")), 12, "0")
    zone = F.struct("image", "start")
    named = names.unique_names(members.withColumn("at", F.concat(place, F.lit("/"), C.sanitized_path(F.col("name")))), "at", ["image", "start", "name", "entry"], "target", zone)
    named = materialise(named, "named-members")
    written = sinks.write_files(named.select("image", F.col("target").alias("path"), "spans", "codec", "entry"), folder).withColumnRenamed("crc", "found_crc")
    status = F.when(F.col("crc").isNull() | (F.col("crc") == 0) | (F.col("crc") == F.col("found_crc")), "ok").otherwise("crcfail")
    return named.join(written, F.col("target") == F.col("path")).select("image", "start", "name", "path", "bytes", "sha256", status.alias("status"))


def seven_zips(scan: Scan) -> DataFrame:
    found = _carve(image.hits(scan.chunks(), [b"7z\xbc\xaf\x27\x1c"]), _plain(carvers.seven_zip))
    return intervals.greedy(found, ["image"], "start", "end", ["off"])


def gzips(scan: Scan) -> DataFrame:
    """gzip streams; their content is unpacked when they are written."""
    return _carve(image.hits(scan.chunks(), [b"\x1f\x8b\x08"]), _plain(carvers.gzip_stream)).withColumn("codec", F.lit("gzip"))


def media(scan: Scan) -> DataFrame:
    """Photos and videos: the first accepted by (offset, signature) wins; those that are zero but for 16 bytes go."""
    found = _carve(image.hits(scan.chunks(), [s for s, _ in carvers.MEDIA]), lambda read, size, off, rank: (f,) if (f := carvers.MEDIA[rank][1](read, size, off)) else None)
    taken = intervals.greedy(found, ["image"], "start", "end", ["off", "sig_rank"])

    def weigh(batches):
        for pdf in batches:
            alive, there = [], []
            for path, s, e in zip(pdf["image"], pdf["start"], pdf["end"], strict=True):
                held, n = image.open_image(path), 0
                for at in range(int(s), min(int(e), held.size), sinks.COPY):
                    part = held.read(at, min(sinks.COPY, int(e) - at))
                    n += len(part) - part.count(0)
                    if n > 16:
                        break
                alive.append(n > 16)
                there.append(max(0, min(int(e), held.size) - int(s)))
            yield pdf.assign(bytes_available=there)[alive]

    return taken.mapInPandas(weigh, PIECES + ", bytes_available long")


def manifest_of(pieces: DataFrame) -> DataFrame:
    """The media manifest, with names by kind and offset."""
    size = F.col("end") - F.col("start")
    name = F.concat("kind", F.lit("/"), F.lpad(F.lower(F.hex("start")), 12, "0"), F.lit("."), "ext")
    return pieces.select(C.hex_offset(F.col("start")).alias("offset_hex"), "kind", "ext", size.alias("size_bytes"), C.human_size(size).alias("size_human"), "method", name.alias("path"), *[c for c in pieces.columns if c == "bytes_available"])


# --- source text ---------------------------------------------------------------------------------------


def printable_extents(scan: Scan, least: int = text.RUN) -> DataFrame:
    """(image, start, end) of maximal printable runs, whatever the windows: parts at a window's edge are joined."""

    def find(batches):
        import re

        pattern = re.compile(rb"[\t\n\r\x20-\x7e]+")
        for pdf in batches:
            rows = []
            for path, base, own, data in zip(pdf["image"], pdf["base"], pdf["own_len"], pdf["data"], strict=True):
                for m in pattern.finditer(data[:own]):
                    if m.end() - m.start() >= least or m.start() == 0 or m.end() == own:
                        rows.append((path, base + m.start(), base + m.end()))
            yield pd.DataFrame(rows, columns=["image", "start", "end"])

    parts = scan.chunks(lookahead=0).mapInPandas(find, "image string, start long, end long")
    return intervals.merge_gaps(parts, ["image"], "start", "end", 0).where(F.col("end") - F.col("start") >= least).drop("members")


def source(scan: Scan, keep_unknown: bool = True) -> DataFrame:
    """Manifest of source fragments, by their language. A run over 64 MiB is classified in pieces of that length."""
    pieces = printable_extents(scan).withColumn("start", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(RUN_LIMIT).cast("long")))).withColumn("end", F.least("end", F.col("start") + RUN_LIMIT))

    def rows(batches):
        for pdf in batches:
            for p, s, e in zip(pdf["image"], pdf["start"], pdf["end"], strict=True):
                yield p, s, e, image.open_image(p).read(int(s), int(e - s))

    def fetch(batches):
        return _in_parts(rows(batches), ["image", "start", "end", "data"], "data")

    found = pieces.mapInPandas(fetch, "image string, start long, end long, data binary")
    named = found.withColumn("t", C.latin1(F.col("data"))).withColumn("found", text.classified(F.col("t"))).withColumn("language", text.kept_language(F.col("found"), F.length("t"), keep_unknown)).where("language IS NOT NULL")
    ext = F.coalesce("found.ext", F.lit("txt"))
    path = F.concat("language", F.lit("/"), F.lpad(F.lower(F.hex("start")), 12, "0"), F.lit("."), ext)
    return named.select(C.hex_offset(F.col("start")).alias("offset_hex"), (F.col("end") - F.col("start")).alias("length"), "language", F.col("found.score").alias("score"), path.alias("path"), C.preview(F.col("t")).alias("preview"), "image", "start", "end")


# --- all -------------------------------------------------------------------------------------------------


def copied(pieces: DataFrame, folder: str, path) -> DataFrame:
    """Write carved pieces by range, unpacked by their ``codec`` if they have one, and return what was written."""
    spans = F.array(F.struct(F.col("start"), (F.col("end") - F.col("start")).alias("length")))
    codec = F.col("codec") if "codec" in pieces.columns else F.lit(None).cast("string")
    return sinks.write_files(pieces.select("image", path.alias("path"), spans.alias("spans"), codec.alias("codec")), folder)


def recover_all(spark: SparkSession, paths: list[str], out: str, block: int = BLOCK, window: int = image.WINDOW, lookahead: int = image.LOOKAHEAD) -> dict[str, dict]:
    """Every phase in order, with manifests, files and a summary below ``out``; returns each phase's figures.

    What later steps read again is a written table, so neither a scan nor a file's writing is repeated if executors are lost.
    """
    whole = Scan(spark, paths, {}, window, lookahead)
    figures, extents = (materialise(d, "analysis") for d in analyze(whole, block))
    regions: dict[str, list] = {}
    for r in extents.orderBy("image", "start").toLocalIterator():
        regions.setdefault(r["image"], []).append((r["start"], r["end"]))
    results = {"analyze": {f"{r['image']}": r.asDict() for r in figures.collect()}}
    sinks.write_json(figures.join(extents.groupBy("image").agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("extents")), "image", "left"), f"{out}/00_analysis/regions")
    report(figures).repartition(1).sortWithinPartitions("image", "line").select("value").write.mode("overwrite").text(f"{out}/00_analysis/report")
    scan = Scan(spark, paths, regions, window, lookahead)
    # images may hold files at the same place
    number = F.element_at(F.map_from_arrays(F.array(*map(F.lit, paths)), F.array(*map(F.lit, range(len(paths))))), F.col("image"))
    place = F.concat(F.when(number > 0, F.concat(F.lit("image"), number.cast("string"), F.lit("-"))).otherwise(""), F.lpad(F.lower(F.hex("start")), 12, "0"))

    listed = materialise(recover_files(mft(scan), f"{out}/10_mft/files"), "listed")
    sinks.write_manifest(listed, f"{out}/10_mft/mft_manifest")
    results["mft"] = aggregates.record_counters(listed).first().asDict()
    events = materialise(journal(scan), "events")
    sinks.write_manifest(events.drop("image", "off"), f"{out}/10_mft/usn_journal")
    results["usn"] = aggregates.journal_counters(events).first().asDict()
    archives, salvaged = (materialise(d, "archives") for d in zip_archives(scan))
    members = materialise(write_members(zip_members(archives, salvaged), f"{out}/20_archives/zip_members"), "members")
    sinks.write_manifest(members, f"{out}/20_archives/zip_manifest")
    results["zip"] = {"whole": copied(archives, f"{out}/20_archives/zip", F.concat(place, F.lit(".zip"))).count(), "salvaged": salvaged.count(), "members": members.count()}
    results["7z"] = {"files": copied(seven_zips(scan), f"{out}/20_archives/7z", F.concat(place, F.lit(".7z"))).count()}
    results["gzip"] = {"files": copied(gzips(scan), f"{out}/20_archives/gzip", place).count()}
    pictures = materialise(media(scan), "pictures")
    sinks.write_manifest(manifest_of(pictures), f"{out}/40_media/media_manifest")
    copied(pictures, f"{out}/40_media", F.concat("kind", F.lit("/"), place, F.lit("."), "ext")).count()
    results["media"] = {r["ext"]: r["n"] for r in aggregates.class_counts(pictures, ["ext"]).collect()}
    fragments = materialise(source(scan), "fragments")
    sinks.write_manifest(fragments.drop("image", "start", "end"), f"{out}/30_source/source_manifest")
    copied(fragments, f"{out}/30_source", F.concat(F.col("language"), F.lit("/"), place, F.lit("."), F.element_at(F.split("path", r"\."), -1))).count()
    results["source"] = {r["language"]: r["n"] for r in aggregates.class_counts(fragments, ["language"]).collect()}
    everything = F.lit(True)
    cards = aggregates.result_cards({"recovered": (listed, F.rlike("recovered", F.lit("^(yes|partial)"))), "deletions": (events, F.contains("reason", F.lit("FILE_DELETE"))), "media": (pictures, everything), "source": (fragments, everything)})
    results["cards"] = {r["card"]: r["n"] for r in cards.collect()}
    sinks.write_text(spark, sinks.summary_lines(json.loads(json.dumps(results, default=str)), out), f"{out}/summary")
    return results
