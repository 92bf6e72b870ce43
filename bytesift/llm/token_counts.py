"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of at most ``table_size`` frequent units and their token counts; tier
two is each worker's bounded cache, filled by the library in batches. No unit is shuffled: the
frequent ones are found by bounded summaries, one row a task, merged in a tree.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import text_slices, with_fields, worker_cache
from bytesift.llm.tokens import LONGEST_CACHED, UnitCache, byte_path, byte_units, load

FAN_IN = 64


def _top(counts: Counter, keep: int) -> pd.DataFrame:
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]
    return pd.DataFrame({"units": [[u for u, _ in best]], "counts": [[n for _, n in best]]})


def frequent_units(docs: DataFrame, text: str, keep: int, per_task: int = 4096) -> list[str]:
    """About the ``keep`` most frequent units of all texts: a cache's content, which no result depends on.

    Each task counts all its units in a table that is cut to its larger half beyond 300,000 entries,
    and hands on its ``per_task`` largest; summaries are merged 64 at a time down to 64, so the
    driver gets at most 64 * ``per_task`` units of at most 48 characters.
    """

    def summarise(batches):
        counts: Counter = Counter()
        for pdf in batches:
            texts = pdf["t"].tolist()
            for i, j in text_slices(texts):
                for t in texts[i:j]:
                    counts.update(byte_units(t))
                if len(counts) > 300_000:
                    counts = Counter(dict(counts.most_common(150_000)))
        counts = Counter({u: n for u, n in counts.items() if n > 1 and len(u) <= LONGEST_CACHED})
        if counts:
            yield _top(counts, per_task)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for units, ns in zip(pdf["units"], pdf["counts"], strict=True):
            counts.update(dict(zip(units, map(int, ns), strict=True)))
        return _top(counts, per_task)

    schema = "units array<string>, counts array<long>"
    rows = docs.select(F.coalesce(text, F.lit("")).alias("t"))
    parts = rows.rdd.getNumPartitions()
    out = rows.mapInPandas(summarise, schema)
    while parts > FAN_IN:
        groups = -(-parts // FAN_IN)
        out = out.withColumn("g", F.spark_partition_id() % F.lit(groups)).groupBy("g").applyInPandas(merge, schema)
        parts = groups
    counts: Counter = Counter()
    for row in out.collect():  # at most FAN_IN rows
        counts.update(dict(zip(row["units"], row["counts"], strict=True)))
    return [u for u, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024, table_size: int = 32_768) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    Counts equal those of the library without added special tokens; the special string inside a
    text is one token, as the library's default has it. A null or empty text: 0, 0, false. Columns
    of these names in ``docs`` are replaced; others pass through. Repeated rows stay. An empty table:
    an empty result.
    """
    path = path or byte_path()
    frequent = frequent_units(docs, text, table_size)
    lengths = [len(e.ids) for e in load(path).encode_batch_fast(frequent, add_special_tokens=False)] if frequent else []
    first = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, lengths, strict=True)))

    @F.pandas_udf("n_bytes long, n_tokens long")
    def count(batches: pd.Series) -> pd.DataFrame:
        cache = _cache(path, first)
        texts = batches.tolist()
        tokens = []
        for i, j in text_slices(texts):
            tokens += map(sum, cache([byte_units(t) for t in texts[i:j]]))
        return pd.DataFrame({"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens}, dtype="int64")

    counted = count.asNondeterministic()(F.coalesce(F.col(text), F.lit("")))
    return with_fields(docs, counted, {"n_bytes": None, "n_tokens": None, "over_limit": F.col("made.n_tokens") > limit})


def _cache(path: str, first) -> UnitCache:
    """This worker's cache; the units it has met stay from task to task."""
    return worker_cache(("counts", path, hash(frozenset(first.value.items()))), lambda: UnitCache(path, len, False, first.value))
