"""Column expressions over decoded values: all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytesift.functions.rules import REASONS

TICKS, EPOCH = 10_000_000, 11_644_473_600
#: Seconds from 1970 to the year 3000 and a little, the last that are shown.
LAST_SECOND = 32_503_680_000


def filetime_iso(ticks: Column) -> Column:
    """100-ns ticks since 1601 as UTC text; 0, times before 1970 and after the year 3000 are empty."""
    seconds = F.floor(ticks / TICKS) - EPOCH
    return F.when((ticks == 0) | (seconds < 0) | (seconds > LAST_SECOND), "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def reason_names(reason: Column) -> Column:
    """Known flags' names joined by ``|``; the hexadecimal value if none is known."""
    names = F.concat_ws("|", *[F.when(reason.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in REASONS])
    known = sum(bit for bit, _ in REASONS)
    return F.when(reason.bitwiseAND(F.lit(known)) == 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(reason)), 8, "0"))).otherwise(names)


#: White space at the ends of a name: what Unicode calls so, and the ASCII separators.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def sanitized_path(path: Column) -> Column:
    """A relative path that is safe on any file system; null and empty become ``unnamed``.

    Backslashes separate too, a drive letter goes; of each segment the outer white space, then the outer dots go, forbidden
    characters become ``_`` and 200 characters stay; empty segments go.
    """
    slashed = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "^[A-Za-z]:", "")
    segments = F.transform(F.split(slashed, "/"), lambda s: F.btrim(F.regexp_replace(s, f"^{_SPACE}|{_SPACE}$", ""), F.lit(".")))
    clean = F.transform(F.filter(segments, lambda s: F.length(s) > 0), lambda s: F.substring(F.regexp_replace(s, r'[<>:"|?*\x00-\x1f]', "_"), 1, 200))
    return F.when(F.size(clean) == 0, "unnamed").otherwise(F.array_join(clean, "/"))


def human_size(n: Column) -> Column:
    """Binary units with one decimal; a negative size by its absolute value's unit."""
    out = F.format_string("%.1f PiB", n / float(1 << 50))
    for power, unit in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB"), (0, "B")):
        out = F.when(F.abs(n) < float(1 << (power + 10)), F.format_string(f"%.1f {unit}", n / float(1 << power))).otherwise(out)
    return out


def hex_offset(offset: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(offset)))


def latin1(data: Column) -> Column:
    """One character per byte, so positions in it are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def byte_count(data: Column, value: int) -> Column:
    text = latin1(data)
    return F.length(text) - F.length(F.replace(text, F.lit(chr(value)), F.lit("")))


def is_dead(data: Column, full: Column) -> Column:
    """``zero`` (all but 16 bytes at most), ``ff`` (a full block of 0xFF only), else null."""
    size = F.octet_length(data)
    return F.when((byte_count(data, 255) == size) & full & (size > 0), "ff").when(byte_count(data, 0) >= size - 16, "zero")


def preview(text: Column, size: int = 60) -> Column:
    return F.translate(F.substring(text, 1, size), "\n", " ")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_contains(path: Column, part: str) -> Column:
    """Whether a path's last segment holds ``part``, whatever its case."""
    return F.contains(F.lower(basename(path)), F.lit(part.lower()))


def storage_label(resident: Column, runs: Column, size: Column) -> Column:
    """Where a file's content is: in its record, in clusters, or nowhere."""
    return F.when(resident, "resident").when(runs > 0, "non-resident").when(size == 0, "empty").otherwise("none")
