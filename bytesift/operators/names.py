"""Names and paths of file records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesift.storage import materialise, release

ROOT, DOS, DEPTH = 5, 2, 64


def picked_name(names: Column) -> Column:
    """Of array<struct<ns, name, parent>>: the longest name outside the DOS space, the first of equals; else the first."""
    others = F.filter(names, lambda n: n["ns"] != DOS)
    longest = F.aggregate(others, F.element_at(others, 1), lambda a, n: F.when(F.length(n["name"]) > F.length(a["name"]), n).otherwise(a))
    return F.when(F.size(others) > 0, longest).when(F.size(names) > 0, F.element_at(names, 1))


def entry_numbers(records: DataFrame, first: int, size: int, offset: str = "off") -> DataFrame:
    """``records`` with ``entry``: aligned records only. Offsets that repeat give one entry each; ``resolve_paths`` takes the last."""
    at = F.col(offset) - first
    return records.where((at >= 0) & (F.pmod(at, F.lit(size)) == 0)).withColumn("entry", (at / size).cast("long"))


def resolve_paths(nodes: DataFrame, depth: int = DEPTH, order: str | None = None) -> DataFrame:
    """``nodes(entry, name, parent)`` with ``path``: the names from the topmost known ancestor down.

    A walk ends at parent 0 or 5 (the root), at a missing parent, at a record that is its own parent, or after
    ``depth`` steps. Of several records of one entry the last by ``order`` (else the largest name and parent) stands
    for it as an ancestor; each keeps a path of its own. Pointers double: after k joins an entry knows 2^k
    ancestors, so six joins cover 64 levels, whatever the tree's size, and cycles end by themselves. Each join's
    result is a written table, and the joins stop as soon as no walk goes on.
    """
    ends = F.col("parent").isNull() | F.col("parent").isin(0, ROOT) | (F.col("parent") == F.col("entry"))
    last = F.max(F.struct(*[F.col(c) for c in ([order] if order else []) + ["name", "parent"]])).alias("last")
    index = nodes.groupBy("entry").agg(last).select("entry", "last.name", "last.parent")
    hops = materialise(index.select("entry", F.array("name").alias("parts"), F.when(~ends, F.col("parent")).alias("up")), "hops")
    reach = 1
    while reach < depth and hops.where("up IS NOT NULL").limit(1).count():
        above = hops.select(F.col("entry").alias("_entry"), F.col("parts").alias("_parts"), F.col("up").alias("_up"))
        joined = hops.join(above, F.col("up") == F.col("_entry"), "left")
        further = materialise(joined.select("entry", F.when(F.col("_parts").isNotNull(), F.concat("_parts", "parts")).otherwise(F.col("parts")).alias("parts"), F.col("_up").alias("up")), "hops")
        release(hops)
        hops, reach = further, reach * 2
    above = hops.select(F.col("entry").alias("_entry"), F.slice("parts", F.greatest(F.lit(1), F.size("parts") - depth + 2), depth - 1).alias("_parts"))
    joined = nodes.withColumn("_up", F.when(~ends, F.col("parent"))).join(above, F.col("_up") == F.col("_entry"), "left")
    return joined.withColumn("path", F.concat_ws("/", F.col("_parts"), F.col("name"))).drop("_up", "_entry", "_parts")


def unique_names(df: DataFrame, path: str, order: list[str], out: str = "unique_path", zone: Column | None = None) -> DataFrame:
    """``df`` with a path that no other row has: the first row of a path keeps it, repeats get ``__n`` before the extension.

    n is the first number free for a repeat, by ``order``: paths that rows bring themselves are never given to
    a repeat. ``zone`` grows with ``order``: a path that very many rows share is numbered zone by zone,
    so its rows don't meet in one task. A null path counts as one name, ``unnamed``.
    """
    rows = df.withColumn(path, F.coalesce(F.col(path), F.lit("unnamed"))).withColumn("_zone", zone if zone is not None else F.lit(0))
    zones = rows.groupBy(path, "_zone").agg(F.count("*").alias("_n"))
    across = Window.partitionBy(path).orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = zones.select(F.col(path).alias("_p"), F.col("_zone").alias("_z"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(path, "_zone").orderBy(*order))
    numbered = rows.withColumn("_i", inside).join(zones, (F.col(path) == F.col("_p")) & F.col("_zone").eqNullSafe(F.col("_z")))
    numbered = numbered.withColumn("_at", (F.col("_i") + F.col("_before") - 1).cast("long")).drop("_zone", "_i", "_p", "_z", "_before")
    # paths that look numbered take their number away from repeats of the path without it
    own = df.select(F.coalesce(F.col(path), F.lit("unnamed")).alias("_own")).distinct()
    root, extension = _cut(F.col("_own"))
    taken = own.withColumn("_base", F.concat(F.regexp_extract(root, r"(?s)^(.*)__[1-9][0-9]{0,17}$", 1), extension)).withColumn("_k", F.regexp_extract(root, r"__([1-9][0-9]{0,17})$", 1))
    taken = taken.where("_k <> ''").select("_base", F.col("_k").cast("long").alias("_k"))
    below = F.row_number().over(Window.partitionBy("_base").orderBy("_k"))
    taken = taken.withColumn("_free", F.col("_k") - below)  # how many numbers under it are free
    repeats = numbered.where("_at > 0").select(F.col(path).alias("_base"), F.col("_at").alias("_free")).distinct()
    marks = taken.select("_base", "_free", F.lit(1).alias("_mark")).join(repeats.select("_base").distinct(), "_base", "left_semi")
    met = repeats.join(marks.select("_base").distinct(), "_base", "left_semi").withColumn("_mark", F.lit(0)).unionByName(marks)
    so_far = F.sum("_mark").over(Window.partitionBy("_base").orderBy("_free", "_mark").rowsBetween(Window.unboundedPreceding, 0))
    skipped = met.withColumn("_skip", so_far).where("_mark = 0").select(F.col("_base").alias("_p"), F.col("_free").alias("_r"), "_skip")
    named = numbered.join(skipped, (F.col(path) == F.col("_p")) & (F.col("_at") == F.col("_r")), "left")
    root, extension = _cut(F.col(path))
    number = (F.col("_at") + F.coalesce("_skip", F.lit(0))).cast("string")
    return named.withColumn(out, F.when(F.col("_at") == 0, F.col(path)).otherwise(F.concat(root, F.lit("__"), number, extension))).drop("_at", "_p", "_r", "_skip")


def _cut(path: Column) -> tuple[Column, Column]:
    """A path without its extension, and the extension with its dot."""
    extension = F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)
    return F.left(path, F.length(path) - F.length(extension)), extension


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
