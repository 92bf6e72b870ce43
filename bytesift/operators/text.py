"""Printable runs in bytes and the language of a piece of source text."""

from __future__ import annotations

from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesift.functions.columns import latin1
from bytesift.functions.rules import LANGUAGES, LEAST, STRONG, WEAK

RUN, KEPT = 160, 600


def text_runs(data: Column, least: int = RUN) -> Column:
    """Maximal runs of tab, LF, CR and 0x20 to 0x7E of at least ``least`` bytes, as text."""
    return F.regexp_extract_all(latin1(data), F.lit(f"[\\t\\n\\r\\x20-\\x7e]{{{least},}}"), F.lit(0))


def run_rows(df: DataFrame, data: str, least: int = RUN) -> DataFrame:
    """One row for each run, with ``run`` (its text), ``run_no`` from 0 and ``length``."""
    return df.select("*", F.posexplode(text_runs(F.col(data), least)).alias("run_no", "run")).withColumn("length", F.length("run").cast("long"))


def once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once however often it is used: the variable of a lambda isn't repeated in the plan."""
    return F.element_at(F.transform(F.array(value), then), 1)


def needed(pattern: str) -> str:
    """The longest text that every match of ``pattern`` holds, as far as its top level shows; empty if none."""
    best = run = ""
    for kind, value in [*parser.parse(pattern), (None, None)]:
        if kind is parser.LITERAL:
            run += chr(value)
        elif kind is not parser.AT:  # a place between characters breaks no run
            best, run = max(best, run, key=len), ""
    return best


def holds(text: Column, pattern: str) -> Column:
    """1 or 0; the pattern is only tried where the text it needs is there. (?d): only LF ends a line."""
    found = F.rlike(text, F.lit(f"(?d){pattern}"))
    literal = needed(pattern)
    return (F.contains(text, F.lit(literal)) & found if literal else found).cast("int")


def classified(text: Column) -> Column:
    """struct<language, ext, score> of the best language, earlier ones winning ties; nulls and 0 below the least score.

    Points count a strong pattern 3 and a weak one 1, whether they hold, and only where a strong one does. Each pattern
    is in the plan once; weak ones are only tried where a strong one holds.
    """

    def held(patterns: list[str]) -> Column:
        return sum((holds(text, p) for p in patterns), F.lit(0))

    def points(strong: list[str], weak: list[str]) -> Column:
        return once(held(strong), lambda n: F.when(n > 0, n * STRONG + held(weak) * WEAK).otherwise(0))

    scored = F.array(*[F.struct(points(strong, weak).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("language"), F.lit(ext).alias("ext")) for k, (name, ext, strong, weak) in enumerate(LANGUAGES)])

    def said(best: Column) -> Column:
        known = best["score"] >= LEAST
        return F.struct(F.when(known, best["language"]).alias("language"), F.when(known, best["ext"]).alias("ext"), F.when(known, best["score"]).otherwise(0).alias("score"))

    return once(F.array_max(scored), said)


def kept_language(found: Column, length: Column, keep_unknown: bool = True, least: int = KEPT) -> Column:
    """The language, or ``other`` for a long piece of none if those are kept; null: dropped."""
    return F.coalesce(found["language"], F.when(F.lit(keep_unknown) & (length >= least), "other"))
