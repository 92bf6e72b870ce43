"""Operators on half-open intervals [start, end) of a group (an image, a user).

A group may be one huge image, so nothing gathers a group in one task: rows are dealt by zones of
the axis, and what crosses zones travels as one summary row a zone.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZONE = 1 << 30


def islands(df: DataFrame, group: list[str], start: str, end: str, gap: int = 0, zone: int = ZONE, touching: bool = True) -> DataFrame:
    """``df`` with ``island`` (long), which numbers a group's runs of intervals from 1 in order of start.

    A new run begins where start exceeds all ends so far by more than ``gap`` (by ``gap`` or more, if not
    ``touching``: then [0, 5) and [5, 9) are apart at gap 0).
    """
    rows = df.withColumn("_zone", F.floor(F.col(start) / zone))
    inside = Window.partitionBy(*group, "_zone").orderBy(start, end)
    local = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    across = Window.partitionBy(*group).orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_zone").agg(F.max(end).alias("_end")).withColumn("_carry", F.max("_end").over(across)).drop("_end")
    same = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in group]
    joined = rows.alias("a").join(sums.alias("b"), [*same, F.col("a._zone") == F.col("b._zone")]).select("a.*", "b._carry")
    reach = F.greatest(local, F.col("_carry"))
    apart = F.col(start) - reach > gap if touching else F.col(start) - reach >= gap
    joined = joined.withColumn("_first", F.when(reach.isNull() | apart, 1).otherwise(0))
    firsts = joined.groupBy(*group, "_zone").agg(F.sum("_first").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    numbered = joined.withColumn("_at", F.sum("_first").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.alias("a").join(firsts.alias("b"), [*same, F.col("a._zone") == F.col("b._zone")]).select("a.*", "b._before")
    return out.withColumn("island", (F.col("_at") + F.col("_before")).cast("long")).drop("_zone", "_carry", "_first", "_at", "_before")


def merge_gaps(df: DataFrame, group: list[str], start: str, end: str, gap: int, zone: int = ZONE) -> DataFrame:
    """(group..., start, end, members): intervals united where the next begins at most ``gap`` after the end so far."""
    runs = islands(df, group, start, end, gap, zone)
    return runs.groupBy(*group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("island")


def _reach(rows: DataFrame, spans: DataFrame, group: list[str], at: str, start: str, end: str, zone: int, touching: bool) -> DataFrame:
    """``rows`` with ``_reach``: the farthest end of ``spans`` that begin before ``at`` (or at it, if ``touching``).

    One sort of both tables by place, zone by zone; what earlier zones reach to comes as one row a zone.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keys = [F.col(f"`{g}`").alias(f"_g{k}") for k, g in enumerate(group)]
    here = rows.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(0 if not touching else 1).alias("_last"), F.lit(None).cast("long").alias("_end"), row.alias("_row"))
    there = spans.select(*keys, F.col(start).cast("long").alias("_at"), F.lit(1 if not touching else 0).alias("_last"), F.col(end).cast("long").alias("_end"), F.lit(None).cast(here.schema["_row"].dataType).alias("_row"))
    both = here.unionByName(there).withColumn("_zone", F.floor(F.col("_at") / zone))
    names = [f"_g{k}" for k in range(len(group))]
    across = Window.partitionBy(*names).orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    ends = there.withColumn("_zone", F.floor(F.col("_at") / zone)).groupBy(*names, "_zone").agg(F.max("_end").alias("_end"))
    zones = here.withColumn("_zone", F.floor(F.col("_at") / zone)).groupBy(*names, "_zone").agg(F.lit(None).cast("long").alias("_end"))
    carry = ends.unionByName(zones).groupBy(*names, "_zone").agg(F.max("_end").alias("_end")).withColumn("_carry", F.max("_end").over(across)).drop("_end")
    inside = Window.partitionBy(*names, "_zone").orderBy("_at", "_last").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_far", F.max("_end").over(inside)).where("_row IS NOT NULL")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*names, "_zone"]]
    return found.alias("a").join(carry.alias("b"), same).select("a._row.*", F.greatest("a._far", "b._carry").alias("_reach"))


def outside(left: DataFrame, right: DataFrame, group: list[str], start: str, end: str, zone: int = ZONE) -> DataFrame:
    """Rows of ``left`` that overlap no interval of ``right``: an anti range join. Of the intervals that begin before a row ends none may end after it begins."""
    return _reach(left, right, group, end, start, end, zone, touching=False).where(F.col("_reach").isNull() | (F.col("_reach") <= F.col(start))).drop("_reach")


def within(points: DataFrame, extents: DataFrame, group: list[str], offset: str, start: str, end: str, zone: int = ZONE) -> DataFrame:
    """Rows of ``points`` whose offset lies in an extent: a semi range join. No extents at all: every row, as a scan of the whole image."""
    if not extents.limit(1).count():
        return points
    return _reach(points, extents, group, offset, start, end, zone, touching=True).where(F.col("_reach") > F.col(offset)).drop("_reach")


class _Free:
    """Accepts an interval that overlaps none accepted before it."""

    def __init__(self):
        self.taken: list[tuple[int, int]] = []

    def __call__(self, start: int, end: int, _) -> bool:
        at = bisect_left(self.taken, (start, end))
        if at and self.taken[at - 1][1] > start or at < len(self.taken) and self.taken[at][0] < end:
            return False
        insort(self.taken, (start, end))
        return True


class _Mark:
    """Accepts what begins at or after the mark; if it counts, it moves the mark to its end."""

    def __init__(self):
        self.mark = None

    def __call__(self, start: int, end: int, counts: bool) -> bool:
        if self.mark is not None and start < self.mark:
            return False
        if counts:
            self.mark = end
        return True


def _fold(df: DataFrame, group: list[str], start: str, end: str, flag: str, order: list[str], zone: int, acceptor) -> DataFrame:
    """The rows that an ``acceptor`` of each island takes in ``order``: intervals of different islands never meet.

    The window deals and sorts the rows by island; the scan after it needs no further exchange.
    """
    runs = islands(df, group, start, end, 0, zone, touching=False)
    numbered = runs.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "island").orderBy(*order)))

    def scan(batches):
        import pyarrow as pa

        accept = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (start, end, flag, "_at")]
            keep = []
            for s, e, f, at in zip(*columns, strict=True):
                if at == 1:
                    accept = acceptor()
                keep.append(accept(s, e, f))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select([c for c in kept.schema.names if c not in ("island", "_at")])

    return numbered.mapInArrow(scan, df.schema)


def greedy(df: DataFrame, group: list[str], start: str, end: str, order: list[str], zone: int = ZONE) -> DataFrame:
    """The intervals that a scan in ``order`` accepts: each that overlaps none accepted before it."""
    return _fold(df, group, start, end, start, order, zone, _Free)


def high_water(df: DataFrame, group: list[str], start: str, end: str, accepted: str, zone: int = ZONE) -> DataFrame:
    """Rows, in order of start, that begin at or after the mark; a row that does and is ``accepted`` moves the mark to its end."""
    return _fold(df, group, start, end, accepted, [start, end], zone, _Mark)


def totals(extents: DataFrame, start: str, end: str) -> DataFrame:
    return extents.agg(F.count("*").alias("extents"), F.coalesce(F.sum(F.col(end) - F.col(start)), F.lit(0)).alias("bytes"))
